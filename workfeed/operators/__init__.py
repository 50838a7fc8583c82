"""Operators over work items."""
