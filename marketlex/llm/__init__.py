"""Training-data operators: token files and counts, language-model and
language scoring, secret scans, near-duplicate and line deduplication,
decontamination and vector search.  Nothing outside this subpackage
imports it."""
