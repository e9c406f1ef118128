"""Column to Column building blocks (JVM expressions only, no Python UDFs)."""
