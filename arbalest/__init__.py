"""Arbalest: retrieval analytics and corpus preparation as PySpark DataFrame jobs."""
