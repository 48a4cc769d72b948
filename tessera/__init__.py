"""Tessera: a Spark-first engine for subgenome-aware sequencing data."""

__version__ = "0.1.0"
