"""Readers for raw recordings and stored examples."""
