"""Corpus, retrieval and evaluation jobs expressed as Spark DataFrame transformations."""
