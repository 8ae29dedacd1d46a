"""Column functions: binning and sequence scoring."""
