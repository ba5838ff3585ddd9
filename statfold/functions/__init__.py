"""Column-level helpers (JVM built-ins composed into expressions)."""
