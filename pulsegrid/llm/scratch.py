"""Intermediate tables and lookups, shared with the rest of the library."""

from pulsegrid.shared import LOOKUP_ROWS, clear, drop, free, lookup, numbered, scratch_path, shared_dir, unused, written

__all__ = ["LOOKUP_ROWS", "clear", "drop", "free", "lookup", "numbered", "scratch_path", "shared_dir", "unused", "written"]
