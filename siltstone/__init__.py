"""Siltstone: Spark DataFrame operators over source-code corpora."""
