"""Policies and the composed plans that they parameterise."""
