"""Operators of a training-data pipeline; nothing else in the library imports this package."""

from genoweave.llm.registry import load

__all__ = ["load"]
