"""Spark-native analytics over versioned documents, retrieval rankings and risk-controlled answers.

Every operator takes DataFrames and returns DataFrames.  The optional subpackage ``llm`` holds the
operators for training-data text; nothing outside it imports it.
"""

__version__ = "0.1.0"
