"""Statistics shared by the operators: distributions, quantiles, moments."""
