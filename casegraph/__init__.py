"""A PySpark engine for evidence-centred case data."""
