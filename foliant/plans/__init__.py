"""Logical pieces: typed values and the plan that stages transform."""
