"""Crawl and contact analytics on Spark DataFrames."""
