"""Column functions: no jobs, no shuffles, everything stays in the JVM."""
