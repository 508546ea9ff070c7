"""Column functions: scoring formulas and id normalisation."""
