"""codeweft: code analytics as Spark plans.

Sub-packages: ``functions`` (column expressions), ``operators`` (table in, table out),
``sources`` and ``sinks`` (readers and reports), ``streaming``, ``plans`` (the registered
queries with their SQL).  ``llm`` is optional and imported by nothing else here.
"""

__version__ = "0.1.0"
