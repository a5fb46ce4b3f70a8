"""Read quality control, trimming and corpus preparation as Spark DataFrame queries."""

__version__ = "1.0.0"
