"""Queries of the corpus operators, by name, and the SQL that some of them equal."""

from . import op1_secrets, op2_urls, op3_simhash, op4_sharding, op5_quality, op6_mixing, op7_syncmers, op8_bpe, op9_language, op10_media, op11_conversations, op12_packing, op13_search

MODULES = (op1_secrets, op2_urls, op3_simhash, op4_sharding, op5_quality, op6_mixing, op7_syncmers, op8_bpe, op9_language, op10_media, op11_conversations, op12_packing, op13_search)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}

#: The others have no equal in SQL: see the README for what each is tested against.
ORACLE_SQL: dict[str, str] = op2_urls.ORACLE_SQL | op13_search.ORACLE_SQL
