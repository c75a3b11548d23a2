"""Maskwright: finding and masking personal data and secrets in text, as Spark expressions."""
