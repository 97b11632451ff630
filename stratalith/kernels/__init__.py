"""Array kernels that grouped functions run."""
