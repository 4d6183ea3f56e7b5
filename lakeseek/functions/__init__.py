"""Column functions: text, dates and document fields."""
