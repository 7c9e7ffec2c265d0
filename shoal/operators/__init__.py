"""Joins and join strategies, data-quality checks, refresh sets, window operators."""
