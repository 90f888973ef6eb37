"""Column-level helpers: null semantics, scalar functions, distributions, ordered sums."""
