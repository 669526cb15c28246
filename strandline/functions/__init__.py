"""Column functions over sequences, headers and orderings."""
