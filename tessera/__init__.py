"""Tessera: document retrieval, grounding and evaluation as PySpark DataFrame operators."""
