"""Pipelines over the operators, and the registered queries with their SQL."""
