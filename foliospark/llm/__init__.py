"""Training-data operators. Nothing outside this subpackage imports it, bar the guarded hook in __spark_entry__.py."""
