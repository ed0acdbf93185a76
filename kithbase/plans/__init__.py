"""Filter trees, sort orders and their compilation to DataFrame plans."""
