"""Text and vector analytics on PySpark."""
