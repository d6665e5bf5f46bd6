"""Settings: resolution of the last writes, and what each write changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletide.functions import colors_malformed, decode_colors, hold_threshold_ms
from tabletide.operators.presets import decode_presets

#: Keys, and of those with a fixed domain the values; the first is the default.
DOMAINS = {"app.themeMode": ["system", "light", "dark", "custom"], "app.hapticLevel": ["off", "on"], "app.logLevel": ["errors", "off", "verbose"], "gt.holdSensitivity": ["medium", "short", "long"]}
BOOLEANS = ["app.keepAwake", "gt.confirmNewGame"]
KEYS = [*DOMAINS, *BOOLEANS, "app.colorProfileId", "app.textScale", "gt.playerColors", "gt.formatPresets"]


def resolved(key: str, value: Column) -> Column:
    """A value as the app reads it: absent or unknown text is the default."""
    if key in DOMAINS:
        return F.when(value.isin(*DOMAINS[key]), value).otherwise(DOMAINS[key][0])
    if key in BOOLEANS:
        return F.coalesce(value.try_cast("boolean"), F.lit(False))
    if key == "app.textScale":
        return F.coalesce(value.try_cast("double"), F.lit(1.0))
    return F.coalesce(value, F.lit("default")) if key == "app.colorProfileId" else value


def last_writes(log: DataFrame) -> DataFrame:
    """user_id and a column for each key: its last value, if any. The keys are fixed, so the pivot is one aggregation."""
    return log.groupBy("user_id").pivot("key", KEYS).agg(F.max_by("value", F.struct("ts", "seq")))


def resolved_columns() -> list[Column]:
    """The resolved settings of a row of last_writes."""
    c = lambda k: F.col(f"`{k}`")
    bad = (c("app.keepAwake").isNotNull() & c("app.keepAwake").try_cast("boolean").isNull()) | (c("gt.confirmNewGame").isNotNull() & c("gt.confirmNewGame").try_cast("boolean").isNull())
    bad = bad | (c("app.textScale").isNotNull() & c("app.textScale").try_cast("double").isNull())
    r = lambda k: resolved(k, c(k))
    return [
        r("app.themeMode").alias("theme_mode"), r("app.colorProfileId").alias("color_profile_id"), r("app.textScale").alias("text_scale"),
        r("app.keepAwake").alias("keep_awake"), r("app.hapticLevel").alias("haptic_level"), r("app.logLevel").alias("log_level"),
        r("gt.confirmNewGame").alias("confirm_new_game"), hold_threshold_ms(r("gt.holdSensitivity")).alias("hold_ms"), bad.alias("bad_values"),
    ]


def settings_snapshot(log: DataFrame) -> DataFrame:
    """One row a user of the log: user_id and the resolved settings, from the last write of each key; bad_values: whether a
    boolean or number doesn't parse, for which the default stands."""
    return last_writes(log).select("user_id", *resolved_columns())


def settings_profiles(log: DataFrame, users: DataFrame) -> DataFrame:
    """The snapshot of every user of users (user_id), defaults for those without a row in the log, with player_colors (the
    saved list, or the palette; null if it is malformed, which colors_malformed tells) and format_presets (the saved list
    by the strict rules of `decode_presets`, empty if there is none or it breaks one)."""
    wide = users.select("user_id").distinct().join(last_writes(log), "user_id", "left")
    colors, saved = F.col("`gt.playerColors`"), F.col("`gt.formatPresets`")
    return wide.select("user_id", *resolved_columns(), decode_colors(colors).alias("player_colors"), colors_malformed(colors).alias("colors_malformed"), decode_presets(saved).alias("format_presets"))


def settings_changes(log: DataFrame) -> DataFrame:
    """user_id, seq, key, theme_changed, wake_changed, log_changed: whether a write changed the resolved theme (mode or colour
    profile), keep-awake or log level. An equal value is no change; before the first write the defaults hold."""
    w = Window.partitionBy("user_id").orderBy("ts", "seq")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keys = {"mode": "app.themeMode", "profile": "app.colorProfileId", "wake": "app.keepAwake", "level": "app.logLevel"}
    rows = log
    for name, key in keys.items():
        rows = rows.withColumn(name, resolved(key, F.last(F.when(F.col("key") == key, F.col("value")), ignorenulls=True).over(upto)))
    defaults = {"mode": F.lit("system"), "profile": F.lit("default"), "wake": F.lit(False), "level": F.lit("errors")}
    changed = {n: ~F.col(n).eqNullSafe(F.coalesce(F.lag(n).over(w), d)) for n, d in defaults.items()}
    return rows.select("user_id", "seq", "key", (changed["mode"] | changed["profile"]).alias("theme_changed"), changed["wake"].alias("wake_changed"), changed["level"].alias("log_changed"))
