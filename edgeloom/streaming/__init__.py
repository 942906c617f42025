"""Statistics of samples that keep arriving."""
