"""Medallion analytics on PySpark: ingest, profile, stage, mart, validate, ask."""
