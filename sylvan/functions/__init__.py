"""Column functions: no shuffle, no state, evaluated inside the JVM."""
