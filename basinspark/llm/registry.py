"""Every query of this package and the SQL that gives the same rows."""

from . import conversations, decontaminate, jaccard, langid, lines, lm, mixing, pages, privacy, quality, runs, tokens, urls

MODULES = [decontaminate, lines, mixing, langid, jaccard, quality, lm, tokens, pages, urls, conversations, runs, privacy]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in MODULES for k, q in m.ORACLE_SQL.items() if q}
