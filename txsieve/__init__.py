"""Screening of financial transactions for fraud, as PySpark batch and streaming jobs."""
