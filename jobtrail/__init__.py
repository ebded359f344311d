"""Job-event analytics on PySpark: event log, rollups, analytics queries and job-lifecycle transforms."""
