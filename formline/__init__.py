"""Race-results analytics as Spark DataFrame operators."""
