"""Pagewright: web pages in a table to clean documents and site dumps, as Spark plans."""

__version__ = "0.1.0"
