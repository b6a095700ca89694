"""Card-grading analytics expressed as Spark DataFrame jobs."""

__all__ = ["session", "schemas", "params"]
