"""Road-crash analytics as PySpark DataFrame operators.

Every operator takes DataFrames (or Columns) and returns a DataFrame (or Column). None of
them runs an action, opens a session or calls a Python function per row.
"""
