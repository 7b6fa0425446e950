"""Column expressions: text, geometry and JSON. Everything here stays in the JVM."""
