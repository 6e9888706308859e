"""commitloom: commit-corpus preparation and evaluation on Spark DataFrames.

Columns go in and come out of ``functions``, DataFrames of ``operators`` and
``plans``; ``sources`` reads and writes landed files and ``streaming`` runs the
incremental ingest. No module creates a session.
"""

__version__ = "0.1.0"
