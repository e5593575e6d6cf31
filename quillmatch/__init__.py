"""Opportunity-matching analytics on PySpark."""
