"""Operators for preparing language-model training data, each a function of DataFrames."""
