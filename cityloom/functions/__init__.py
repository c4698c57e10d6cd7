"""Part of the building-stock engine."""
