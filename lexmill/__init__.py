"""lexmill: text, evidence and operational analytics as plain Spark DataFrame operators."""
