"""Functions from Columns to Columns, and the few plug-points where Python is needed."""
