"""Word lists, weights, thresholds and lookup tables that the operators apply."""
