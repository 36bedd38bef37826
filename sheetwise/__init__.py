"""Grading and auditing of scanned answer sheets as Spark DataFrame jobs."""
