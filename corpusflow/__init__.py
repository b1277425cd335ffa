"""corpusflow: Spark-first curation, scoring and evaluation of transcript corpora."""

__version__ = "0.1.0"
