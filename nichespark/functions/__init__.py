"""Scalar, aggregate and window expressions used by the operators."""
