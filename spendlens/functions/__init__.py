"""Column helpers and distributed ranking."""
