"""Durations, bucket sizes, steps and times as users write them; all in milliseconds."""

from __future__ import annotations

import math
import re
from datetime import datetime

from ..model import AUTO_BUCKETS_S

_UNITS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
_PART = re.compile(r"(\d+\.?\d*|\.\d+)(ms|[smhdw])")
_FLOAT = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\Z")
_RFC3339 = re.compile(r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)\Z")


def duration_ms(text: str) -> int | None:
    """30s, 1h30m, 1.5s: numbers with units, more than nothing in all."""
    text, at, total = text.strip(), 0, 0.0
    while at < len(text):
        m = _PART.match(text, at)
        if m is None:
            return None
        total += float(m[1]) * _UNITS[m[2]]
        at = m.end()
    return _round(total) if 0 < total < 1e13 else None


def bucket_ms(text: str) -> int | None:
    """Seconds or a duration, a second at least."""
    text = text.strip()
    if re.fullmatch(r"[0-9]+", text):
        ms = int(text) * 1000
        return ms if 1000 <= ms < 2**63 else None
    ms = duration_ms(text)
    return ms if ms is not None and ms >= 1000 else None


def auto_bucket_ms(span: int) -> int:
    """The least usual size that makes about 120 buckets of the span at most."""
    return next((s * 1000 for s in AUTO_BUCKETS_S if span // (s * 1000) <= 120), AUTO_BUCKETS_S[-1] * 1000)


def time_ms(text: str) -> int:
    """Seconds, milli-, micro- or nanoseconds since 1970, told apart by size, or RFC 3339."""
    text = text.strip()
    if _FLOAT.match(text) and 0 <= (n := float(text)) < math.inf:
        scale = next((s for least, s in ((1e17, 1e-6), (1e14, 1e-3), (1e11, 1.0)) if n >= least), 1e3)
        return math.floor(n / round(1 / scale)) if scale < 1 else math.floor(n * scale)
    found = rfc3339_ms(text)
    if found is None:
        raise ValueError(f"invalid time {text!r}")
    return found


def rfc3339_ms(text: str) -> int | None:
    if not _RFC3339.match(text):
        return None
    try:
        when = datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", text.upper().replace(" ", "T")))
    except ValueError:
        return None
    return math.floor(round(when.timestamp() * 1e6) / 1000)


def step_ms(text: str) -> int:
    """Seconds, also fractions of one, or a duration."""
    text = text.strip()
    ms = _round(float(text) * 1000) if _FLOAT.match(text) and math.isfinite(float(text)) else duration_ms(text)
    if ms is None:
        raise ValueError(f"invalid step {text!r}")
    if ms < 1:
        raise ValueError("step must be positive")
    return ms


def default_step_ms(start: int, end: int) -> int:
    """About 250 points, in whole seconds, one at least."""
    return max(1000, (end - start) // 250 // 1000 * 1000)


def _round(x: float) -> int:
    return math.floor(x + 0.5) if x >= 0 else -math.floor(-x + 0.5)
