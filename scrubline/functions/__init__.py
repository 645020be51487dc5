"""Column-level building blocks, rule tables and label expressions."""
