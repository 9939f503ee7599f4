"""Korridor: as-of-correct transit analytics and corpus operators on Spark DataFrames."""
