"""Column functions: no shuffles, no UDFs."""
