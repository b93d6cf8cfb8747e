"""Column-expression builders. Everything here returns a ``pyspark.sql.Column``."""
