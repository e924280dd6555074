"""Request-redundancy analytics on Spark."""
