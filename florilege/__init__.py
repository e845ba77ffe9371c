"""Florilege: a literature triage and retrieval engine written for Spark SQL."""
