"""Column functions: rules, names, hashes, diffs."""
