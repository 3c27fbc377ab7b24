"""Columns and SQL functions."""

from pathloom.functions.columns import JsonPath, jsonpath_count, jsonpath_indices, jsonpath_many, jsonpath_nodes, jsonpath_spans
from pathloom.functions.sql import register

__all__ = ["JsonPath", "jsonpath_count", "jsonpath_indices", "jsonpath_many", "jsonpath_nodes", "jsonpath_spans", "register"]
