"""Column helpers, all native expressions."""
