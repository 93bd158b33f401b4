"""Named queries over the given tables, with the same result as plain SQL where SQL can say it."""

from genoweave.registry.core import load

__all__ = ["load"]
