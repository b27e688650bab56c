"""Column expressions: keys, text, scores.  All run in the JVM."""
