"""Graphloom: source trees as relations, activity logs as tables, and analytics over both, on Spark DataFrames."""
