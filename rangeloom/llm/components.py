"""Connected components of a link table, without gathering links on the driver."""

from rangeloom.operators.components import connected_components

__all__ = ["connected_components"]
