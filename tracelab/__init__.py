"""Spark-native analytics over denoising traces, answer judgements and token corpora."""
