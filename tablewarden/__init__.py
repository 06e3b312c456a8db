"""Metadata governance on Spark: load, reconcile, audit and change a registry of
tables, columns, indexes, sequences and codes, all as DataFrame jobs."""
