"""Operators of pagewright."""
