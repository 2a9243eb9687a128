"""Analytics over recorded web sessions, as Spark DataFrame pipelines.

``sources`` reads chunks, manifests and ledgers; ``functions`` holds column expressions; ``operators`` turns DataFrames into
DataFrames; ``streaming`` runs ingestion in micro-batches; ``plans`` is the catalogue of queries.
"""
