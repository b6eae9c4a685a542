"""Resumable appends as a file stream."""
