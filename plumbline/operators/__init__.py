"""Ordered, robust, join, regression, matrix and inference operators on DataFrames."""
