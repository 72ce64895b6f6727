"""Intermediate tables in the folder that all executors share."""

from ..scratch import Scratch, shared_root

__all__ = ["Scratch", "shared_root"]
