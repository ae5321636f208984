"""Readers, writers, schemas and landed-payload ingestion."""
