"""pathloom: JSONPath over raw JSON, VARIANT and typed columns, built on Spark DataFrames."""

__version__ = "0.1.0"
