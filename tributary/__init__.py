"""Click-log analytics on Spark: cleaning, sessions, graphs, propagation, metrics."""
