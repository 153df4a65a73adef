"""tracefold: trajectory privacy analytics as DataFrame and SQL operations."""
