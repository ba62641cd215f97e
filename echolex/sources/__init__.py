"""Readers and writers: text files, Parquet tables, in-memory rows."""
