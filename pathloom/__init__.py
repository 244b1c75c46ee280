"""Link discovery on time-partitioned graphs that are stored as tables."""
