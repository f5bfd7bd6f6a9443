"""Document-intelligence operators expressed as Spark DataFrame transformations."""
