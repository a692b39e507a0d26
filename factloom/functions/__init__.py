"""Scalar column functions used by the operators; all stay in the JVM."""
