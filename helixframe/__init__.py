"""Distributed de novo assembly and corpus preparation on Spark DataFrames."""
