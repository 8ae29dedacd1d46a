"""Scratch tables in the folder that driver and executors share."""

from rangeloom.storage import scratch_path, shared_dir, stored

__all__ = ["scratch_path", "shared_dir", "stored"]
