"""Scratch tables of these operators: see foliagrid.scratch."""

from ..scratch import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]
