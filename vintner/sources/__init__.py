"""Scans and sources: Parquet, CSV (plain and delimiter-sniffed), literal rows, landing."""

from vintner.sources.csv import read_csv_strings, read_sniffed_csv, sniff_delimiter
from vintner.sources.dialect import sniff_dialect
from vintner.sources.landing import land_once
from vintner.sources.quoted_csv import read_quoted_csv
from vintner.sources.tables import frame_from_rows, read_parquet, read_table

__all__ = ["read_parquet", "read_table", "frame_from_rows", "read_csv_strings",
           "read_quoted_csv", "sniff_delimiter", "sniff_dialect", "read_sniffed_csv", "land_once"]
