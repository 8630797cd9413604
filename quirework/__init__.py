"""quirework: a PySpark engine for messy document collections and their records."""
