"""Evidence-table analytics for many devices, written as Spark jobs."""

__version__ = "0.1.0"
