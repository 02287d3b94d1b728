"""Panel analytics on Spark: presence labels, pauses, features, reports, drift and scoring."""
