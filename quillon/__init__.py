"""A Spark-first search, analytics and data-processing engine for card-catalogue data."""
