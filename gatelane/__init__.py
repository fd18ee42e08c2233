"""Gateway analytics on Spark: screening, semantic caching, routing, metering,
benchmark evaluation and classifier corpora, all as DataFrame jobs."""

__version__ = "0.1.0"
