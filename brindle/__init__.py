"""brindle: label ranking and corpus preparation on Spark."""
