"""A PySpark engine for duplicate content and data lint."""
