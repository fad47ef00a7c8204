"""Spark-native text governance: detect, score, decide, redact, audit and evaluate over DataFrames."""
