"""Whole queries: the operators put together over tables."""
