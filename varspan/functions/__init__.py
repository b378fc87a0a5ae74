"""Column functions: all of them JVM expressions."""
