"""kiln: DataFrame operators for curating, scoring and evaluating reasoning data on Spark."""
