"""Plans of pagewright."""
