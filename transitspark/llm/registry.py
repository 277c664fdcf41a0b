"""All queries of this subpackage and the SQL of those that SQL can express."""

from . import byte_bpe, embedding_join, packing, periodic_runs, phrases, pieces, quality, secrets, simhash, syncmers, token_files, toxicity, warc

MODULES = [secrets, toxicity, pieces, simhash, warc, syncmers, packing, embedding_join, token_files, quality, periodic_runs, byte_bpe, phrases]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
