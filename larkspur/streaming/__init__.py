"""Pipelines over streams."""

from .stateless import stream_pipeline

__all__ = ["stream_pipeline"]
