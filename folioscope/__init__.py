"""A document retrieval and analytics engine on PySpark.

functions  Column expressions: text, numbers, geometry
sources    format detection, reading, messages, idempotent writes
operators  splitting, chunking, dense and lexical retrieval, fusion, citations, answers
streaming  the stage graph, retry rules and the stateful ingest query
plans      the registered queries and their SQL
"""
