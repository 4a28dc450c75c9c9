"""rowquarry: tables in, searchable text chunks and ranked answers out, all as Spark DataFrames."""

__version__ = "0.1.0"
