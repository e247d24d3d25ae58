"""Reliability analytics for group-held-out prediction, as Spark DataFrame operators."""

__version__ = "0.1.0"

# Part of every split hash and cache key: raise it whenever preprocessing changes results.
PREPROC_VERSION = "1"
