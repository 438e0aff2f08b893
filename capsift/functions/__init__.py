"""Column-level helpers; all of them stay inside the JVM."""
