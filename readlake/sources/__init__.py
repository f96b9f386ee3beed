"""Readers. ``read`` looks at the first bytes of a file and picks the reader."""

from readlake.sources.reader import read, register, sniff

__all__ = ["read", "register", "sniff"]
