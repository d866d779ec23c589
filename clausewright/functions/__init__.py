"""Column-level building blocks. Everything here stays inside the JVM."""
