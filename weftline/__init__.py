"""Dataflow and analytics operators written directly on Spark DataFrames."""
