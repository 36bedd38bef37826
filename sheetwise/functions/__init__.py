"""Column functions: answer texts, gates, geometry and reason messages."""
