"""Column expressions on DNA strings."""
