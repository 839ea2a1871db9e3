"""Readers and writers (parquet test tables, CSV, text corpora, vectors)."""
