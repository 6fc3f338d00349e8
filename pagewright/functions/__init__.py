"""Functions of pagewright."""
