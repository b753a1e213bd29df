"""Part of the core engine."""
