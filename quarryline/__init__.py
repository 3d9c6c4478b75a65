"""Evidence-driven entity analytics on PySpark."""
