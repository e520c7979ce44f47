"""Readers and writers: tables, feature dictionaries, workbooks."""

from .tables import feature_dictionary, normalise_dictionary, read_csv, read_parquet, read_spaced
from .xlsx import Chart, write_workbook

__all__ = ["Chart", "feature_dictionary", "normalise_dictionary", "read_csv", "read_parquet", "read_spaced", "write_workbook"]
