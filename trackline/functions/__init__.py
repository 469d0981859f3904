"""Column expressions: unit conversions, weather labels, filters."""
