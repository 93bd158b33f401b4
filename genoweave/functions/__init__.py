"""Column expressions; nothing here triggers a job or leaves the JVM unless a name says so."""
