"""Continuous ingestion by structured streaming."""
