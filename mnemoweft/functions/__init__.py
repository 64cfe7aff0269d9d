"""Column functions: each takes and gives Columns, runs in the JVM and is safe for nulls."""
