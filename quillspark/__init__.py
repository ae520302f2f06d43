"""quillspark: a PySpark-native text-retrieval analytics engine.

Sub-packages: ``functions`` (column builders), ``operators`` (DataFrame to
DataFrame), ``sources`` (scans and sinks), ``plans`` (config, stage cache,
build DAG, command line), ``streaming`` (incremental ingest), ``queries``
(the catalogue the driver runs).  The optional sub-package ``llm`` holds the
training-data operators; nothing else here imports it.
"""

__version__ = "0.1.0"
