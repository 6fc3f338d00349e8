"""Sources of pagewright."""
