"""Source blocks."""

from weftline.sources import files, generator, remote  # noqa: F401
