"""DataFrame-in, DataFrame-out monitoring operators."""
