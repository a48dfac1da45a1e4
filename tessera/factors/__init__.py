"""Factor formulas, by family."""
