"""Column -> Column helpers: everything here stays inside generated JVM code."""
