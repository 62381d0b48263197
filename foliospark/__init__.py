"""Document-extraction analytics as Spark DataFrame transformations."""
