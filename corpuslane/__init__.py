"""Corpus analytics on Spark DataFrames: ingest, clean, sample, index, rank, evaluate, audit and roll up paper corpora."""
