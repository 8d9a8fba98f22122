"""Query plans and the query catalogue."""
