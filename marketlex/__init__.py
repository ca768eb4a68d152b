"""marketlex: text and daily-market analytics as Spark DataFrame jobs.

Every public operator is either ``Column -> Column`` (scalar text/array
functions) or ``DataFrame -> DataFrame`` (table operators).  Nothing
collects rows to the driver except bounded lookup tables whose size is
checked first.
"""

from marketlex.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
