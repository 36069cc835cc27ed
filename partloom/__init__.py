"""Supplier-data analytics on Spark: tables in, tables out."""
