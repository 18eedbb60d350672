"""runloom: document ingest and hybrid retrieval as Spark plans."""

__version__ = "0.1.0"
