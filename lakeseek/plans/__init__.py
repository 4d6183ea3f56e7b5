"""Whole queries and jobs made of operators."""
