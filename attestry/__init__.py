"""Document-evidence analytics as PySpark DataFrame operators."""
