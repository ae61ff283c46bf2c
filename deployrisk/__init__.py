"""Deployment-risk analytics on Spark DataFrames."""
