"""Column expressions: no UDFs, so everything stays in generated JVM code."""
