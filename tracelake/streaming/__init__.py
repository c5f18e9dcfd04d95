"""Streaming forms of the frequency operators; an extension."""
