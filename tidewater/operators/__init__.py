"""Operators on bars, forecasts and scores. Each takes and returns DataFrames that are keyed by series."""
