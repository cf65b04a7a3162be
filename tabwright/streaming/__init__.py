"""Scoring of rows that keep arriving."""
