"""The ingest pipeline as data: its stage graph, retry rules, and a stateful streaming query."""
