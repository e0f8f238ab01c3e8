"""Plan-level helpers: shared scratch storage, skew handling, fixpoint loops."""
