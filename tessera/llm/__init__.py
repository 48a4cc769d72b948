"""Operators for text corpora and similarity work; optional, imported by nothing else."""
