"""News-corpus analytics as Spark DataFrame operators.

Every operator takes DataFrames (or Columns) and returns a DataFrame (or a
Column).  Dictionaries, gazetteers and site rules are input tables.
"""
