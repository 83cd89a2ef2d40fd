"""Queries over the driver's tables, with the SQL that they equal."""
