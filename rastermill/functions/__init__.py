"""Column functions on grids and product metadata."""
