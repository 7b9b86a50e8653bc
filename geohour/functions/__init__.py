"""Column expressions: time, text, numbers, projections, plane geometry."""
