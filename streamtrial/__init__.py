"""Learning from, and comparing models on, ordered data streams with Spark."""
