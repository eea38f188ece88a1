"""Column expressions: everything here stays inside JVM codegen."""
