"""Column builders: predicates, survey codes, curves and labels."""
