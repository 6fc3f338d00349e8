"""Streaming of pagewright."""
