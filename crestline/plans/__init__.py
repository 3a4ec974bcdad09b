"""Composite panels and estimation suites built from the operators."""
