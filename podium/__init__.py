"""Tournament-usage analytics as Spark DataFrame operators."""
