"""tidemark: keyed hourly time-series analytics as Spark DataFrame operators."""
