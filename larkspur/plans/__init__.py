"""Compilers from filters, pipelines and updates to DataFrame plans."""
