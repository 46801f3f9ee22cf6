"""Column expressions: text, dates, numbers, JSON and missing values."""
