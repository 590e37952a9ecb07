"""Readers and writers of the text layers."""
