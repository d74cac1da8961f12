"""Redaction and corpus analytics over Spark DataFrames."""
