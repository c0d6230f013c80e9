"""weftline: Spark-native curation and evaluation of region- and text-level datasets."""

__version__ = "0.1.0"
