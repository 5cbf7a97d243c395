"""Evidence-based document analytics on PySpark."""
