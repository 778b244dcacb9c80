"""Column-level building blocks. All are built-in expressions; nothing leaves the JVM."""
