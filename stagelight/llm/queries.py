"""The queries of this subpackage, one for each operator."""

from stagelight.llm import bytespans, chat, decontaminate, embeddings, langid, minhash, mixing, negatives, pieces, pii, quality, substrings, whitening

MODULES = (langid, chat, pieces, embeddings, substrings, bytespans, quality, minhash, mixing, pii, negatives, decontaminate, whitening)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
