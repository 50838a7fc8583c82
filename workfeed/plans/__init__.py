"""The driver's tables bound to work items, the named queries and their SQL."""
