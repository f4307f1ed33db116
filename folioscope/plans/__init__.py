"""The registered queries of the engine's own operators, with DuckDB SQL for those that SQL can express."""

from folioscope.plans import answering, indexes, ingest, retrieval, tables, texts, whole

MODULES = (texts, ingest, retrieval, answering, whole, indexes, tables)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
