"""Whole flows built from the operators, and the catalog of registered queries."""
