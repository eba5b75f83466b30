"""Analyzers over tables: missingness, duplicates, density."""
