"""Named queries over the driver's tables, and the catalog."""
