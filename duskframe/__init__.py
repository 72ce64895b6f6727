"""duskframe: analytics over time-stamped imaging surveys, written for Spark."""
