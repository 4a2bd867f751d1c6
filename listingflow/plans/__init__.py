"""Whole runs composed from the operators, and the queries over the test tables."""
