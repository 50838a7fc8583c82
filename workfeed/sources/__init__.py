"""Landed files and tables as typed work items."""
