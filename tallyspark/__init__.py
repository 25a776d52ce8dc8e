"""Usage-log and quota analytics for coding-agent session logs, as Spark jobs."""
