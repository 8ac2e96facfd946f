"""Column -> Column helpers that pin the warehouse semantics on Spark."""
