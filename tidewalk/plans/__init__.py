"""Queries over the study's tables, with their SQL."""
