"""Column functions: scalars and aggregates, all evaluated in the JVM."""
