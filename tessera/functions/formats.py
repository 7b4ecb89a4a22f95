"""Units and number formats of measurement text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nanoseconds and bytes in a unit.
TIME_UNITS = {"ns": 1.0, "us": 1e3, "µs": 1e3, "μs": 1e3, "ms": 1e6, "s": 1e9}
BYTE_UNITS = {"B": 1.0, "kB": 1024.0, "KB": 1024.0, "MB": 1024.0**2, "GB": 1024.0**3, "TB": 1024.0**4}


def _scaled(text: Column, units: dict[str, float]) -> Column:
    value = F.regexp_extract(text, r"^\s*([-+]?[0-9]*\.?[0-9]+)\s*([A-Za-zµμ]+)\s*$", 1)
    unit = F.regexp_extract(text, r"^\s*([-+]?[0-9]*\.?[0-9]+)\s*([A-Za-zµμ]+)\s*$", 2)
    factor = F.element_at(F.create_map(*[F.lit(x) for kv in units.items() for x in kv]), unit)
    return F.when((value != "") & F.array_contains(F.array(*[F.lit(u) for u in units]), unit), value.try_cast("double") * factor)


def nanoseconds(text: Column) -> Column:
    """Nanoseconds of "12.5ms" and the like; null if the unit is unknown."""
    return _scaled(text, TIME_UNITS)


def bytes_of(text: Column) -> Column:
    """Bytes of "1.5MB" and the like, by powers of 1024; null if the unit is unknown."""
    return _scaled(text, BYTE_UNITS)


def per_second(mean_ns: Column) -> Column:
    """Operations a second; 0 for a mean of 0."""
    return F.when(mean_ns == 0, F.lit(0.0)).otherwise(F.lit(1e9) / mean_ns)


def duration(ns: Column) -> Column:
    """Text by magnitude: ns, µs, ms or s."""
    return (
        F.when(ns < 1e3, F.concat(F.format_string("%.1f", ns), F.lit(" ns")))
        .when(ns < 1e6, F.concat(F.format_string("%.2f", ns / 1e3), F.lit(" µs")))
        .when(ns < 1e9, F.concat(F.format_string("%.2f", ns / 1e6), F.lit(" ms")))
        .otherwise(F.concat(F.format_string("%.2f", ns / 1e9), F.lit(" s")))
    )


def grouped_number(x: Column) -> Column:
    """Whole numbers with a space between thousands."""
    return F.translate(F.format_number(x, 0), ",", " ")


def short_count(n: Column) -> Column:
    """1000 as 1k, 1000000 as 1M, others as they are."""
    return F.when((n >= 1_000_000) & (n % 1_000_000 == 0), F.concat((n / 1_000_000).cast("long").cast("string"), F.lit("M"))).when((n >= 1000) & (n % 1000 == 0), F.concat((n / 1000).cast("long").cast("string"), F.lit("k"))).otherwise(n.cast("string"))
