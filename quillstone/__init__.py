"""Analytics engine on PySpark DataFrames: tables, keyed memory, search, vectors, text, code and graphs."""
