"""tessera: official-statistics analytics as Spark DataFrame jobs.

Subpackages
-----------
functions   scalar column functions (coercion, codes, period labels)
operators   DataFrame -> DataFrame operators (tidy, joins, aggregates, windows, sets, forecasts, models)
sources     readers and writers (workbooks, CSV/JSON releases, catalog reads, manifests, sinks)
plans       composed data products and their bindings to the driver tables
streaming   incremental loading of new releases with Structured Streaming
"""

__version__ = "0.1.0"
