"""Validators and document rewriting on DataFrames."""
