"""Blocks over unbounded input."""

from weftline.streaming.pipeline import StreamPipeline, generator_stream  # noqa: F401
