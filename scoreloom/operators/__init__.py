"""Binning, weights of evidence, metrics, selection, models and scorecards over DataFrames."""
