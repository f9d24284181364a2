"""Retrieval and data processing for session logs and text memories, as plain DataFrame plans."""
