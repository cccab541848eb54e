"""Floeline: workflow-state analytics on Spark DataFrames."""
