"""Vector arithmetic as SQL text, for pairs of rows; whole searches multiply matrices of Arrow batches."""

from __future__ import annotations


def dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS double) * CAST(y AS double)), 0D, (s, x) -> s + x)"


def cosine(a: str, b: str) -> str:
    """Cosine; 0 if either vector is zero."""
    return f"coalesce({dot(a, b)} / nullif(sqrt({dot(a, a)}) * sqrt({dot(b, b)}), 0D), 0D)"


def min_max(x: str, over: str = "") -> str:
    """Scaled to [0, 1] over a window; all 1 where nothing differs."""
    return f"CASE WHEN max({x}) OVER ({over}) = min({x}) OVER ({over}) THEN 1D ELSE ({x} - min({x}) OVER ({over})) / (max({x}) OVER ({over}) - min({x}) OVER ({over})) END"
