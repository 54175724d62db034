"""textmill: matching, ranking and audit operators over text, as plain PySpark DataFrame functions."""
