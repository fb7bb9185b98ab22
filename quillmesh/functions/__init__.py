"""Normal forms and similarity kernels."""
