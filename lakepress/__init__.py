"""Media-monitoring analytics as Spark DataFrame plans."""
