"""Whole dataflows: ingestion, answering, evaluation and the report."""
