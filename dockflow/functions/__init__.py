"""Column-level functions. Everything here stays inside JVM expressions."""
