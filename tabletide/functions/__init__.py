"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabletide.schemas import HOLD_MS, PALETTE, QUARTER_TURNS


def lookup(col: Column, table: dict, otherwise=None) -> Column:  # noqa: ANN001
    found = F.lit(otherwise)
    for k, v in reversed(table.items()):
        found = F.when(col == k, F.lit(v)).otherwise(found)
    return found


def quarter_turns(seat: Column) -> Column:
    return lookup(seat, QUARTER_TURNS)


def hold_threshold_ms(sensitivity: Column) -> Column:
    """Milliseconds of a sensitivity; unknown text is medium."""
    return lookup(sensitivity, HOLD_MS, HOLD_MS["medium"])


def hold_sensitivity(ms: Column) -> Column:
    """The inverse: 250 is short, 600 long, anything else medium."""
    return F.when(ms == 250, "short").when(ms == 600, "long").otherwise("medium")


def pending_label(delta: Column) -> Column:
    """'+5', '-3', or null for 0, which is hidden."""
    return F.when(delta > 0, F.concat(F.lit("+"), delta.cast("string"))).when(delta < 0, delta.cast("string"))


def resolve_theme(mode: Column) -> Column:
    return F.when(mode == "custom", "light").otherwise(mode)


def palette() -> Column:
    return F.array(*[F.lit(c).cast("long") for c in PALETTE])


def decode_colors(text: Column) -> Column:
    """JSON list of integers to ARGB numbers. Absent text is the default palette; malformed text is null, which
    `colors_malformed` tells apart."""
    return F.when(text.isNull(), palette()).otherwise(F.when(~colors_malformed(text), F.from_json(text, "array<bigint>")))


def colors_malformed(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"^\s*\[\s*(-?\d+\s*(,\s*-?\d+\s*)*)?\]\s*$"), F.lit(False))


def encode_colors(colors: Column) -> Column:
    return F.to_json(colors)


def preset_chip(name: Column, life: Column) -> Column:
    return F.concat(name, F.lit("  "), life.cast("string"), F.lit("♥"))


def preset_subtitle(life: Column, count: Column) -> Column:
    return F.concat(life.cast("string"), F.lit(" life · "), count.cast("string"), F.lit(" players"))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")
