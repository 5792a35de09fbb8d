"""Column expressions over strings and bytes."""
