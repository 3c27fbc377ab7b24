"""Physical operators: the byte scanner, the tree evaluator and the node table."""
