"""Column functions: native expressions first, Arrow-batched Python where the JVM has no counterpart."""
