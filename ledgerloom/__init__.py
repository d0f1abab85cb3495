"""Governed, content-addressed knowledge-graph analytics on Spark."""
