"""Structured data from documents that fill a visual template, as Spark plans."""
