"""Service-inventory analytics expressed as Spark DataFrame transformations."""
