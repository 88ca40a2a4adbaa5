"""Register analytics on PySpark: segments, reports, matching, page text, state tables and streams."""
