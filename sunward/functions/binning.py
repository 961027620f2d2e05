"""Left-closed labelled bins."""

from pyspark.sql import Column, functions as F

from .values import _c


def _edge(x) -> str:
    if x in (float("inf"), float("-inf")):
        return "inf" if x > 0 else "-inf"
    return repr(float(x))


def interval_labels(edges) -> list:
    return [f"[{_edge(a)}, {_edge(b)})" for a, b in zip(edges, edges[1:])]


def cut(x, edges, missing=None) -> Column:
    """Label of the half-open bin holding ``x``; ``missing`` outside every bin."""
    c = _c(x)
    known = c.isNotNull() & ~F.isnan(c.cast("double"))
    out = None
    for low, high, label in zip(edges, edges[1:], interval_labels(edges)):
        inside = known
        if low != float("-inf"):
            inside = inside & (c >= low)
        if high != float("inf"):
            inside = inside & (c < high)
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out.otherwise(F.lit(missing).cast("string"))


def floor_bin(x, width: float) -> Column:
    """Start of the equal-width bin holding ``x``."""
    return F.floor(_c(x) / width).cast("double") * width


def equal_width_bin(x, low, high, bins: int) -> Column:
    """0-based bin of ``x`` in [low, high], the last edge belonging to the last bin."""
    c = _c(x)
    low, high = _c(low) if isinstance(low, str) else F.lit(low) if not isinstance(low, Column) else low, (
        _c(high) if isinstance(high, str) else F.lit(high) if not isinstance(high, Column) else high)
    raw = F.floor((c - low) / (high - low) * bins)
    inside = (c >= low) & (c <= high)
    return F.when(inside, F.least(raw, F.lit(bins - 1)).cast("int"))
