"""A PySpark engine for geographic attribute layers."""
