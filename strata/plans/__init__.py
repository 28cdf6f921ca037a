"""Plan fragments shared by operators: prefix sums, compaction planning."""
