"""Readers of logs, pages, snapshots and issues."""
