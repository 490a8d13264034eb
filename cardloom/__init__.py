"""Cardloom: text retrieval and knowledge-card analytics on Spark DataFrames."""
