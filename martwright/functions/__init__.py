"""Column functions: money, labels, keys and text."""
