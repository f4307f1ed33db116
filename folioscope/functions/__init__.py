"""Column expressions; everything here stays in the JVM unless a name says otherwise."""
