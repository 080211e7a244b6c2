"""End-to-end jobs and the query catalogue bound to the test tables."""
