"""Scalar functions: expressions that stay in the JVM, and numpy versions for fits."""
