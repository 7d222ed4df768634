"""Composed jobs, the views over the benchmark tables and the query catalog."""
