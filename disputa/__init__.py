"""Argument-graph analytics on DataFrames."""
