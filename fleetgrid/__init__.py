"""Occupancy mapping over fleets of range scans, as plain Spark DataFrame jobs."""
