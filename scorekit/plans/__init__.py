"""Analyses, cleaning, extraction and the query registry."""
