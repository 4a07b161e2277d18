"""Scalar vocabulary as Column builders (inventory P1-P23)."""
