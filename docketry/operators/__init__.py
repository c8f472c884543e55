"""Dataset-level operators: joins, dedup, ranking, batching, metering."""
