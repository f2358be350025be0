"""Column functions and driver-side column-name resolution."""
