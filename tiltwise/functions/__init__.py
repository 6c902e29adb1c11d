"""Column expressions: every function here stays in the JVM unless it says otherwise."""
