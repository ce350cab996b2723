"""Labelled-content, knowledge-graph and dialogue analytics on Spark DataFrames."""

__version__ = "0.1.0"
