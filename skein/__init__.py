"""skein: Spark-first analytics over line-addressed text and ordered record streams."""
