"""Forensic analytics on Spark: log and file-system records in, findings out."""
