"""Column functions and per-file text kernels."""
