"""Stages of both halves, each a function of DataFrames keyed by document."""
