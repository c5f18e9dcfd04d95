"""Operators over log entries and file-system records."""
