"""Evidence-checked message analytics on Spark."""
