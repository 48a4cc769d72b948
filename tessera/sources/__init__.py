"""Readers and writers of sequencing file formats."""
