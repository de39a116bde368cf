"""Column-to-column expressions: every function here takes and returns a Column."""
