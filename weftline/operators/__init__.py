"""Transform blocks."""

from weftline.operators import attributes, geometry, quality, spatial  # noqa: F401
