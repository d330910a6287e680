"""Whole analyses, and the catalogue of queries with their SQL."""
