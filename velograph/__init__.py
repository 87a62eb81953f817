"""A trajectory and census analytics engine written as Spark DataFrame transformations."""
