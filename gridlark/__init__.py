"""Gridlark: detection analytics and corpus preparation as plain Spark jobs."""
