"""Numerical kernels on arrays, for use inside grouped maps."""
