"""Fixture views, whole grading plans and the query catalogue."""
