"""Column expressions: cleaning, labels and guarded arithmetic."""
