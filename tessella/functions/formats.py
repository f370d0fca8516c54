"""Display of numbers, dates, shares and ratios, for reports on the driver."""

from __future__ import annotations

import math
from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal

DASH = "—"


def fixed(x: float, places: int) -> str:
    """Decimal places, the exact binary value rounded half away from zero."""
    out = str(Decimal(x).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))
    return out[1:] if float(out) == 0 and out[0] == "-" and x == 0 else out


def grouped(x: float, places: int) -> str:
    """Thousands apart, at most so many decimals, no trailing zeros."""
    out = f"{Decimal(x).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP):,f}"
    return out.rstrip("0").rstrip(".") if "." in out else out


def _finite(x: float | None) -> bool:
    return x is not None and math.isfinite(x)


def number(x: float | None) -> str:
    if not _finite(x):
        return DASH
    size = abs(x)
    if size == 0:
        return "0"
    if size >= 1e12:
        return fixed(x / 1e12, 2) + "兆"
    if size >= 1e8:
        return fixed(x / 1e8, 2) + "億"
    if size >= 1e4:
        return fixed(x / 1e4, 1 if size >= 1e6 else 2) + "万"
    if size >= 1:
        return grouped(x, 1 if size >= 100 else 2)
    if size >= 0.01:
        return fixed(x, 3)
    power = math.floor(math.log10(size))
    head = fixed(x / 10.0**power, 2)
    if abs(float(head)) >= 10:
        head, power = fixed(x / 10.0 ** (power + 1), 2), power + 1
    return f"{head}e{'-' if power < 0 else '+'}{abs(power)}"


def day(days: float | None) -> str:
    return (date(1970, 1, 1) + timedelta(days=math.floor(days))).isoformat() if _finite(days) else DASH


def percent(x: float | None) -> str:
    return fixed(x * 100, 1) + "%" if _finite(x) else DASH


def count(n: int) -> str:
    return f"{n:,}"


def ratio(x: float | None) -> str:
    if not _finite(x) or x <= 0:
        return DASH
    return fixed(x, 0 if x >= 10 else 2) + "倍"


def by_kind(kind: str, x: float | None) -> str:
    return day(x) if kind == "datetime" else percent(x) if kind == "boolean" else number(x)
