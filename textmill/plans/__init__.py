"""Whole runs: the staged pipeline, experiment tracking, request-shaped entry points, reports."""
