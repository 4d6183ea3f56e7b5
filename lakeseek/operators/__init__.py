"""DataFrame operators: retrieval, extraction, change tracking, presentation."""
