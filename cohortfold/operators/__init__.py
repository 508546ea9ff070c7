"""Row-level operators: records, matching, statistics, scoring, merging."""
