"""Connected components of a graph in a table: node, root for every node of edges (a, b), two long columns."""

from ..operators.graph import roots as components

__all__ = ["components"]
