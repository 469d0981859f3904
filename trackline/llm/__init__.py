"""Operators for preparing language-model training data, each on whole tables of any size."""
