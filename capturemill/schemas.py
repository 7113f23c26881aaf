"""Table schemas as DDL."""

LOG_LINES = "run_id bigint, tool string, seq bigint, ts timestamp, line string"
