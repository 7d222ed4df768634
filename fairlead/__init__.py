"""Fairlead: transport-observation analytics as Spark DataFrame jobs."""
