"""Readers of transcript files and writers of reports."""
