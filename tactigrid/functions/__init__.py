"""Column-level functions: stencils, borders, 2x2 matrices, colour."""
