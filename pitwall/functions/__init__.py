"""Column-level functions: VARIANT projection and scalar business rules."""
