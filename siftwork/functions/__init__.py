"""Column functions: text, numbers, colours and bit hashes. All are JVM-side expressions."""
