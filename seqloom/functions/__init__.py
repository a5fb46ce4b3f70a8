"""Column functions on reads and small numeric kernels."""
