"""Filters, pipeline stages, lookups and updates, each a function of DataFrames."""
