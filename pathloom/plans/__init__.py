"""Logical plans: which way a query is executed on a column of a given type."""

from pathloom.plans.table import jsonpath_table, jsonpath_values, parsed_values
from pathloom.plans.typed import typed_matches
from pathloom.plans.variant import variant_matches, variant_values

__all__ = ["jsonpath_table", "jsonpath_values", "parsed_values", "typed_matches", "variant_matches", "variant_values"]
