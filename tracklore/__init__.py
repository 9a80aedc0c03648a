"""Agent-run analytics on Spark: declarative plans over recorded trajectories."""
