"""Text scalar functions, ``Column -> Column``, equal to Python ``re`` semantics.

Java regex is not Unicode-aware by default, so the Python classes are
spelled out.  The same pattern strings are valid RE2 (DuckDB) syntax, which
lets the SQL oracles reuse them verbatim.
"""

from __future__ import annotations

from functools import lru_cache
from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal Python ``re`` / the reference's character sets).
# Python ``\w``: letters, numbers, underscore.
WORD = r"[\p{L}\p{N}_]"
# Python ``\s`` / ``str.isspace()`` code points.
SPACE_CHARS = (r"\t\n\x0B\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
               r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
SPACE = "[" + SPACE_CHARS + "]"
NONSPACE = "[^" + SPACE_CHARS + "]"
# Letters kept by the Polish-text filters, besides a-z, A-Z and 0-9.
POLISH_LETTERS = "ĄąĆćĘęŁłŃńÓóŚśŹźŻż"
# Labels of the three sentiment classes, by class id.
SENTIMENT_NAMES = ("Negative", "Neutral", "Positive")
# ---------------------------------------------------------------------------

URL_PATTERN = f"http{NONSPACE}+|www{NONSPACE}+|https{NONSPACE}+"
HASHTAG_PATTERN = f"#{WORD}+"
MENTION_PATTERN = f"@{WORD}+"
CASHTAG_PATTERN = rf"\${WORD}+"
NON_POLISH_PATTERN = f"[^a-zA-Z{POLISH_LETTERS}0-9{SPACE_CHARS}?!]"
NON_POLISH_STRICT_PATTERN = f"[^a-zA-Z{POLISH_LETTERS}0-9{SPACE_CHARS}]"
TCO_PATTERN = rf"https?://t\.co/{NONSPACE}+"
# Java only: ``(?d)`` makes ``.`` exclude just ``\n`` as Python does.
REPEAT_PATTERN = r"(?d)(.)\1+"
SENTENCE_START_PATTERN = f"(^|[.!?]{SPACE}+)({WORD})"
_MARK = "\u0001"
# Java only, for long texts: the same matches as the patterns above (or as
# several of them one after another), but a first small test decides the
# common characters, and chained classes are asked for the others alone.
FAST_URL = f"(?=[hw])(?:http|www){NONSPACE}+"
FAST_TAGS = f"[@#]{WORD}+"
_LISTED = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"  # one bit set; ranges are asked one by one
FAST_NON_POLISH = f"[[^{_LISTED}]&&[^{POLISH_LETTERS}]]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_urls(t) -> Column:
    """``http\\S+|www\\S+|https\\S+`` -> one blank."""
    return F.regexp_replace(_c(t), FAST_URL, " ")


def strip_hashtags(t) -> Column:
    """``#\\w+`` -> one blank."""
    return F.regexp_replace(_c(t), HASHTAG_PATTERN, " ")


def strip_mentions(t) -> Column:
    """T4: ``@\\w+`` -> one blank."""
    return F.regexp_replace(_c(t), MENTION_PATTERN, " ")


def strip_cashtags(t) -> Column:
    """T5: ``$\\w+`` -> one blank."""
    return F.regexp_replace(_c(t), CASHTAG_PATTERN, " ")


def keep_polish_text(t) -> Column:
    """Every char outside Latin/Polish letters, digits, whitespace, ``?!`` -> blank."""
    return F.regexp_replace(_c(t), NON_POLISH_PATTERN, " ")


def collapse_repeats(t) -> Column:
    """Runs of one repeated char (newline excepted) -> one char."""
    return F.regexp_replace(_c(t), REPEAT_PATTERN, "$1")


def strip_unicode(t) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(t), f"^{SPACE}+|{SPACE}+$", "")


def normalize_whitespace(t) -> Column:
    """Runs of whitespace -> one blank, then strip."""
    return F.trim(F.regexp_replace(_c(t), f"{SPACE}+", " "))


def sentence_case(t) -> Column:
    """Lower-case, then upper-case the first word char of the text and
    after every ``[.!?]`` followed by whitespace."""
    marked = F.regexp_replace(F.lower(_c(t)), SENTENCE_START_PATTERN, "$1" + _MARK + "$2")
    parts = F.split(marked, _MARK, -1)
    fixed = F.transform(
        parts,
        lambda p, i: F.when(i == 0, p).otherwise(
            F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))))
    return F.array_join(fixed, "")


def strip_tco(t) -> Column:
    """T.co links -> empty, then Unicode strip."""
    return strip_unicode(F.regexp_replace(_c(t), TCO_PATTERN, ""))


def clean_text_full(t) -> Column:
    """URLs, mentions+hashtags, underscores, non-Polish chars -> blank; squeeze."""
    x = F.regexp_replace(strip_urls(t), FAST_TAGS, " ")
    # underscores are no letters: with the other characters and the white
    # space around them they become one blank
    return F.trim(F.regexp_replace(x, FAST_NON_POLISH, " "))


def clean_text_basic(t) -> Column:
    """Mentions then URLs -> blank."""
    return strip_urls(strip_mentions(t))


def text_length(t) -> Column:
    """Length in code points (as Python ``len``)."""
    return F.length(_c(t))


def whitespace_tokens(t) -> Column:
    """Python ``str.split()``: tokens between runs of Unicode whitespace.
    One regex pass; the only empty pieces are at the ends (leading or
    trailing whitespace, or an empty text) and are removed."""
    return F.array_remove(F.split(_c(t), f"{SPACE}+", -1), "")


def token_count(t) -> Column:
    """Number of whitespace tokens."""
    return F.size(whitespace_tokens(t))


def remove_stopwords(t, words: Iterable[str]) -> Column:
    """Drop tokens whose lower form is a stop word; join by one blank.

    ``words`` is a bounded in-memory list (the lookup becomes a hash set
    through Catalyst's ``InSet`` conversion).  For large lists use
    :func:`marketlex.operators.textops.remove_stopwords_table`.
    Null input passes through as null.
    """
    return F.array_join(kept_tokens(t, words), " ")


def kept_tokens(t, words: Iterable[str]) -> Column:
    """The tokens :func:`remove_stopwords` keeps, as an array (its size is the
    token count of the result, without splitting the joined text again)."""
    ws = sorted(set(words))
    toks = whitespace_tokens(t)
    return F.filter(toks, lambda w: ~F.lower(w).isin(ws)) if ws else toks


# ------------------------------------------------------------- lexicon fold
@lru_cache(maxsize=32)
def _prefilter_exact(pairs: tuple, prefix: str = " ") -> bool:
    """True when skipping keys absent from the *input* text cannot change the
    result: no inserted text can take part in a later key in any alignment --
    holding it, overlapping either end of it, or lying inside it (text on
    both sides; an empty insertion lies inside every longer key)."""
    whole, head, tail, inside = {}, {}, {}, {}   # fragment -> last entry whose key has it there
    for i, (k, _) in enumerate(pairs):
        whole[k] = i
        for n in range(1, len(k)):
            head[k[:n]] = tail[k[n:]] = i
        for x in range(1, len(k)):
            for y in range(x, len(k)):
                inside[k[x:y]] = i
    longest = max((len(k) for k, _ in pairs), default=0)
    for i, (_, v) in enumerate(pairs):
        new = prefix + v
        if inside.get(new, -1) > i:
            return False
        for n in range(1, min(longest, len(new)) + 1):
            if head.get(new[-n:], -1) > i or tail.get(new[:n], -1) > i:
                return False
            if any(whole.get(new[x:x + n], -1) > i for x in range(len(new) - n + 1)):
                return False
    return True


LEXICON_CHUNK = 2000
# From this many one-code-point keys on, one regex pass finds which of them
# occur instead of one substring scan per key.
SINGLE_KEY_SCAN = 8


def _code_point_class(chars, gap: int = 64) -> str:
    """A regex class covering ``chars`` with few ranges (code points closer
    than ``gap`` are merged).  It may also match other characters; callers
    test membership exactly afterwards."""
    cps = sorted(ord(c) for c in chars)
    ranges = [[cps[0], cps[0]]]
    for cp in cps[1:]:
        if cp - ranges[-1][1] <= gap:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return "[" + "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def replace_lexicon(t, pairs: Sequence[tuple[str, str]], prefix: str = " ") -> Column:
    """Apply ``text.replace(key, prefix + value)`` for every entry, in order.

    Expressed as a fold (``aggregate``) over an array-of-struct literal, so it
    stays JVM-side (no Python worker, no per-row serialisation).  Entries
    whose key is absent from the row are filtered out first when that is
    provably exact for this lexicon; one-code-point keys (most emoji) are
    tested against the set of such characters found by a single regex pass,
    longer keys by a substring test.  Lexicons longer than
    ``LEXICON_CHUNK`` entries are applied as successive folds over
    consecutive chunks (order is preserved).
    """
    pairs = tuple((str(k), str(v)) for k, v in pairs)
    col = _c(t)
    if not pairs:
        return col
    exact = _prefilter_exact(pairs, prefix)
    for start in range(0, len(pairs), LEXICON_CHUNK):
        chunk = pairs[start:start + LEXICON_CHUNK]
        singles = sorted({k for k, _ in chunk if len(k) == 1})
        scan = exact and len(singles) >= SINGLE_KEY_SCAN
        lex = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(prefix + v).alias("v"),
                                 F.lit(scan and len(k) == 1).alias("one"))
                        for k, v in chunk])

        def fold(s, found, lex=lex):
            if exact:
                keep = (lambda kv: F.when(kv["one"], F.array_contains(found, kv["k"]))
                        .otherwise(s.contains(kv["k"]))) if found is not None else \
                       (lambda kv: s.contains(kv["k"]))
                lex = F.filter(lex, keep)
            return F.aggregate(lex, s, lambda acc, kv: F.replace(acc, kv["k"], kv["v"]))

        # Bind the row's text (and the set of one-code-point keys present,
        # from one regex pass) to lambda variables: expressions captured by
        # the per-entry lambdas would otherwise be re-evaluated per entry.
        if scan:
            found = F.array_distinct(F.regexp_extract_all(col, F.lit(_code_point_class(singles)), 0))
            bound = F.array(F.struct(col.alias("s"), found.alias("f")))
            col = F.element_at(F.transform(bound, lambda b: fold(b["s"], b["f"])), 1)
        else:
            col = F.element_at(F.transform(F.array(col), lambda s: fold(s, None)), 1)
    return col


def replace_emoji(t, lexicon: Sequence[tuple[str, str]] | None = None) -> Column:
    """T1 with the emoticon lexicon by default (see ``functions.lexicon``)."""
    from marketlex.functions.lexicon import EMOTICONS
    return replace_lexicon(t, EMOTICONS if lexicon is None else lexicon)
