"""Column functions: text, dates, numbers."""
