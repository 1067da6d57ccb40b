"""Queries of this subpackage and their SQL, by name."""

from quillgrid.llm import alignment, ann, bpe, chat, decontaminate, html_text, langid, minhash, quality, repair, repeats, sharding, toxicity

MODULES = [alignment, ann, bpe, chat, decontaminate, html_text, langid, minhash, quality, repair, repeats, sharding, toxicity]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
