"""Sink blocks."""

from weftline.sinks import files, remote  # noqa: F401
