"""Audit-log analytics and incident tracking as Spark DataFrame operators."""
