"""Truth-scored event memory on Spark: every operator is DataFrame in, DataFrame out."""
