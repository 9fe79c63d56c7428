"""Whole lifecycles, built from the operators."""
