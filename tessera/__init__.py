"""Schema-checked SQL analytics on PySpark."""
