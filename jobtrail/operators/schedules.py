"""Next run times of schedules, as column expressions.

Each distinct expression is parsed once, into a bit mask per field, and joined back to the rows that use it (adaptive
execution broadcasts the masks if they are small). In a row the rest is arithmetic: the days of a month that fit are a
mask, too, and the next minute, hour or day is the lowest set bit above the present one. Months ahead are searched only
where the present and the next month hold no run. The local time found is turned into an instant of the schedule's time
zone; only around clock changes all candidates are tried, day by day until one exists.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail.functions.scalar import settle

# Short forms, field bounds and names of the cron format.
DESCRIPTORS = {
    "@yearly": "0 0 1 1 *",
    "@annually": "0 0 1 1 *",
    "@monthly": "0 0 1 * *",
    "@weekly": "0 0 * * 0",
    "@daily": "0 0 * * *",
    "@midnight": "0 0 * * *",
    "@hourly": "0 * * * *",
}
MONTH_NAMES = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DAY_NAMES = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]
FIELDS = [
    ("minutes", 0, 59, {}),
    ("hours", 0, 23, {}),
    ("doms", 1, 31, {}),
    ("months", 1, 12, {n: i + 1 for i, n in enumerate(MONTH_NAMES)}),
    ("dows", 0, 6, {n: i for i, n in enumerate(DAY_NAMES)}),
]
YEARS_AHEAD = 5
UNIT_NANOS = {
    "ns": 1,
    "us": 1_000,
    "µs": 1_000,
    "ms": 1_000_000,
    "s": 1_000_000_000,
    "m": 60_000_000_000,
    "h": 3_600_000_000_000,
}
_DURATION = r"^[+-]?((\d+(\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h))+$"
_ZONES = sorted(zoneinfo.available_timezones() - {"localtime", "Factory"})


def _number(token: Column, names: dict[str, int]) -> Column:
    # Only digits are cast: a failing cast is far dearer than the test.
    n = F.when(token.rlike(r"^\d{1,9}$"), token.try_cast("int"))
    if names:
        table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        n = F.coalesce(n, F.try_element_at(table, F.lower(token)))
    return n


def _field(text: Column, low: int, high: int, names: dict[str, int]) -> Column:
    """The entries of a field, such as ``*/5``, ``9-17`` or ``mon``, as (values, star); NULL when
    one is invalid. Each step names what it found, so that nothing is worked out twice."""
    steps = F.transform(
        F.filter(F.split(text, ","), lambda e: e != ""), lambda e: F.struct(F.split(e, "/").alias("pieces"))
    )
    steps = F.transform(steps, lambda e: F.struct(e["pieces"], F.split(e["pieces"][0], "-").alias("ends")))
    steps = F.transform(
        steps,
        lambda e: F.struct(
            e["ends"][0].isin("*", "?").alias("star"),
            F.size(e["pieces"]).alias("n_pieces"),
            F.size(e["ends"]).alias("n_ends"),
            _number(e["ends"][0], names).alias("first"),
            _number(F.get(e["ends"], F.lit(1)), names).alias("last"),
            F.when(F.size(e["pieces"]) == 1, F.lit(1))
            .otherwise(_number(F.get(e["pieces"], F.lit(1)), {}))
            .alias("step"),
        ),
    )
    steps = F.transform(
        steps,
        lambda e: F.struct(
            F.when(e["star"], F.lit(low)).otherwise(e["first"]).alias("lo"),
            F.when(e["star"] | ((e["n_ends"] == 1) & (e["n_pieces"] == 2)), F.lit(high))
            .when(e["n_ends"] == 1, e["first"])
            .otherwise(e["last"])
            .alias("hi"),
            e["step"].alias("step"),
            (e["star"] & (e["step"] == 1)).alias("star"),
            ((e["n_pieces"] <= 2) & ((e["n_ends"] <= 2) | e["star"])).alias("shaped"),
        ),
    )
    ok = lambda e: (
        e["shaped"] & (e["lo"] >= low) & (e["hi"] <= high) & (e["lo"] <= e["hi"]) & (e["step"] > 0)
    )
    entries = F.transform(
        steps,
        lambda e: F.when(ok(e), F.struct(F.sequence(e["lo"], e["hi"], e["step"]).alias("values"), e["star"])),
    )
    return F.when(F.forall(steps, lambda e: F.coalesce(ok(e), F.lit(False))), entries)


def parse_cron(df: DataFrame, expr: Column, prefix: str = "_c_") -> DataFrame:
    """Add the parsed expression: ``text``, ``zone`` (of a TZ= prefix), ``every`` (nanoseconds), a
    sorted array per field, ``dom_star``/``dow_star`` and ``ok``."""
    c = lambda name: f"{prefix}{name}"
    zone_rx = r"^(?:CRON_)?TZ=(\S+)\s+(.*)$"
    df = df.withColumn(c("raw"), expr).withColumns(
        {
            c("zone"): F.when(F.col(c("raw")).rlike(zone_rx), F.regexp_extract(c("raw"), zone_rx, 1)),
            c("text"): F.when(
                F.col(c("raw")).rlike(zone_rx), F.trim(F.regexp_extract(c("raw"), zone_rx, 2))
            ).otherwise(F.col(c("raw"))),
        }
    )
    text = F.col(c("text"))
    known = F.lit(None).cast("string")
    for name, fields in DESCRIPTORS.items():
        known = F.when(text == name, F.lit(fields)).otherwise(known)
    every_text = F.when(text.startswith("@every "), F.substring(text, F.lit(8), F.length(text)))
    parts = F.regexp_extract_all(every_text, F.lit(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)"), F.lit(0))
    unit = F.create_map(*[F.lit(x) for u, n in UNIT_NANOS.items() for x in (u, float(n))])
    nanos = F.aggregate(
        parts,
        F.lit(0.0),
        lambda acc, p: acc
        + F.regexp_extract(p, r"^[\d.]+", 0).try_cast("double")
        * F.try_element_at(unit, F.regexp_extract(p, r"[a-zµ]+$", 0)),
    )
    sign = F.when(every_text.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    # Shorter than a second becomes a second; fractions of a second are cut.
    every = F.when(
        every_text.rlike(_DURATION),
        F.greatest(F.floor(sign * nanos / 1e9), F.lit(1)).cast("bigint") * F.lit(1_000_000_000),
    )
    df = settle(
        df,
        {
            c("every"): every,
            c("tokens"): F.filter(
                F.split(F.when(text.startswith("@"), known).otherwise(text), r"\s+"), lambda t: t != ""
            ),
        },
    )
    tokens = F.col(c("tokens"))
    entries, values, stars = {}, {}, {}
    for i, (name, low, high, names) in enumerate(FIELDS):
        token = F.when(F.size(tokens) == 5, tokens[i])
        single = F.when(token.rlike(r"^\d{1,2}$"), token.try_cast("int"))
        # Most fields are a star or one number; only the others are taken apart.
        listed = F.col(c(f"{name}_list"))
        entries[c(f"{name}_list")] = F.when((token != "*") & single.isNull(), _field(token, low, high, names))
        values[c(name)] = (
            F.when(token == "*", F.sequence(F.lit(low), F.lit(high)))
            .when(single.isNotNull(), F.when(single.between(low, high), F.array(single)))
            .when(listed.isNotNull(), F.array_sort(F.flatten(F.transform(listed, lambda e: e["values"]))))
        )
        stars[name] = (token == "*") | F.coalesce(F.exists(listed, lambda e: e["star"]), F.lit(False))
    df = settle(df, entries)
    df = settle(df, values | {c("dom_star"): stars["doms"], c("dow_star"): stars["dows"]})
    all_fields = F.lit(True)
    for name, *_ in FIELDS:
        all_fields = all_fields & F.col(c(name)).isNotNull()
    ok = F.coalesce(all_fields | F.col(c("every")).isNotNull(), F.lit(False))
    return df.withColumn(c("ok"), ok).drop(c("raw"), c("tokens"), *entries)


def valid_zone(zone: str) -> Column:
    """Whether a column names a zone known to the zone database here and to the engine."""
    names = ", ".join(f"'{z}'" for z in _ZONES)
    probe = f"try_make_timestamp(2000, 1, 1, 0, 0, 0, {zone}) IS NOT NULL"
    return F.expr(f"IF({zone} IN ({names}), {probe}, false)")


def _bit(mask: str, at: str) -> str:
    return f"(shiftright({mask}, {at}) & 1) = 1"


def _lowest(mask: str) -> str:
    """Number of the lowest set bit of a mask that is not 0."""
    return f"bit_count(({mask} & -({mask})) - 1)"


def _above(mask: str, bit: str) -> str:
    """The mask without its bits up to ``bit``."""
    return f"({mask} & shiftleft(-1L, {bit} + 1))"


def _days(p: str, first: str) -> str:
    """The mask of the days of a month that fit, bit 1 for its first day, which is the date ``first``.

    The mask of weekdays is turned to begin with the weekday of the first and repeated five times.
    """
    turn = f"(dayofweek({first}) - 1)"
    week = f"((shiftright({p}dw, {turn}) | shiftleft({p}dw, 7 - {turn})) & 127L)"
    by_week = f"({week} * {sum(1 << 7 * i for i in range(5))}L * 2L)"
    fits = f"IF({p}both, {p}dm & {by_week}, {p}dm | {by_week})"
    return f"IF({_bit(p + 'mo', f'month({first})')}, {fits} & (shiftleft(1L, day(last_day({first})) + 1) - 2L), 0L)"


def _runs_on_day(day: Column, zone: Column, start: Column, p: str) -> Column:
    """The first instant after ``start`` on a local calendar day, or NULL.

    A local time that a clock change skips has no instant; one that it repeats has two.
    """
    local = F.from_utc_timestamp(start, zone)
    # On the day of the start, runs before its hour are over (a repeated hour may still come).
    first_hour = F.when(day == F.to_date(local), F.hour(local) - 2).otherwise(F.lit(-1))
    hours = F.filter(F.expr(f"filter(sequence(0, 23), h -> {_bit(p + 'ho', 'h')})"), lambda h: h >= first_hour)
    minutes = F.expr(f"filter(sequence(0, 59), m -> {_bit(p + 'mi', 'm')})")
    at_midnight = F.unix_micros(day.cast("timestamp"))

    def instants(hour: Column, minute: Column) -> Column:
        wall = F.timestamp_micros(at_midnight + (hour * 60 + minute).cast("bigint") * F.lit(60_000_000))
        base = F.unix_micros(F.to_utc_timestamp(wall, zone))
        shifts = F.array(*[F.lit(m * 60_000_000).cast("bigint") for m in (-60, -30, 0, 30, 60)])
        options = F.transform(shifts, lambda s: F.timestamp_micros(base + s))
        return F.array_min(F.filter(options, lambda x: (F.from_utc_timestamp(x, zone) == wall) & (x > start)))

    return F.array_min(F.transform(hours, lambda h: F.array_min(F.transform(minutes, lambda m: instants(h, m)))))


def _next_cron(df: DataFrame, start: Column, p: str, out: str) -> DataFrame:
    c = lambda name: F.col(f"{p}{name}")
    zone = c("tz")
    ready = c("ok") & c("every").isNull() & start.isNotNull() & c("zone_ok")
    df = df.withColumns({f"{p}local": F.when(ready, F.from_utc_timestamp(start, zone))})
    parts = {"h": "hour({l})", "m": "minute({l})", "d": "day({l})", "first": "to_date(trunc({l}, 'month'))"}
    df = df.withColumns({f"{p}{name}": F.expr(e.format(l=f"{p}local")) for name, e in parts.items()})
    first, second = f"{p}first", f"add_months({p}first, 1)"
    masks = {"m0": _days(p, first), "m1": _days(p, second), "lm": _above(f"{p}mi", f"{p}m"), "lh": _above(f"{p}ho", f"{p}h")}
    df = df.withColumns({f"{p}{name}": F.expr(e) for name, e in masks.items()})

    # The first local time after the start: today, or at the first time of the next day that fits.
    later_today = f"""CASE WHEN NOT {_bit(p + 'm0', p + 'd')} THEN NULL
        WHEN {_bit(p + 'ho', p + 'h')} AND {p}lm <> 0 THEN {p}h * 60 + {_lowest(p + 'lm')}
        WHEN {p}lh <> 0 THEN {_lowest(p + 'lh')} * 60 + {_lowest(p + 'mi')} END"""
    ahead = f"12 * {YEARS_AHEAD + 1} - month({first})"  # months up to December in YEARS_AHEAD years
    far = f"get(filter(sequence(2, {ahead}), k -> {_days(p, f'add_months({first}, k)')} <> 0), 0)"
    rest = _above(f"{p}m0", f"{p}d")
    next_month = f"CASE WHEN {rest} <> 0 THEN 0 WHEN {p}m1 <> 0 THEN 1 ELSE {far} END"
    df = df.withColumns({f"{p}left": F.expr(later_today)})
    df = df.withColumns({f"{p}k": F.when(c("local").isNotNull() & c("left").isNull(), F.expr(next_month))})
    month = f"add_months({first}, {p}k)"
    df = df.withColumns({f"{p}in": F.expr(f"IF({p}k = 0, {rest}, {_days(p, month)})")})
    day = f"IF({p}left IS NOT NULL, date_add({first}, {p}d - 1), date_add({month}, {_lowest(p + 'in')} - 1))"
    minute_of_day = f"coalesce({p}left, {_lowest(p + 'ho')} * 60 + {_lowest(p + 'mi')})"
    wall = F.unix_micros(F.expr(day).cast("timestamp")) + F.expr(minute_of_day).cast("bigint") * F.lit(60_000_000)
    df = df.withColumns({f"{p}wall": F.timestamp_micros(wall)})
    df = df.withColumns({f"{p}at": F.to_utc_timestamp(f"{p}wall", zone)})

    # That is the answer unless a clock change interferes: the local time is skipped, or the start
    # lies close before or inside a repeated hour.
    soon = start + F.expr("INTERVAL 3 HOURS")
    steady = F.unix_micros(F.from_utc_timestamp(soon, zone)) - F.unix_micros(soon) == F.unix_micros(
        f"{p}local"
    ) - F.unix_micros(start)
    plain = steady & (F.from_utc_timestamp(f"{p}at", zone) == c("wall")) & (c("at") > start)
    df = df.withColumns({f"{p}plain": F.when(c("at").isNotNull(), plain)})
    in_month = f"filter(sequence(1, 31), d -> {_bit(_days(p, f'add_months({first}, k)'), 'd')} AND (k > 0 OR d >= {p}d))"
    dates = f"flatten(transform(sequence(0, {ahead}), k -> transform({in_month}, d -> date_add(add_months({first}, k), d - 1))))"
    none = F.lit(None).cast("timestamp")
    # Days after the first one that has a run are not looked at.
    checked = F.aggregate(
        F.when(~c("plain"), F.expr(dates)), none, lambda found, d: F.coalesce(found, _runs_on_day(d, zone, start, p))
    )
    return df.withColumns({out: F.when(c("plain"), c("at")).otherwise(checked)})


MASKS = {"mi": "minutes", "ho": "hours", "dm": "doms", "mo": "months", "dw": "dows"}


def parsed_schedules(schedules: DataFrame, p: str) -> DataFrame:
    """Masks and flags of distinct schedules (_of, cron_expr, timezone), with ``p`` before the names."""
    df = parse_cron(schedules, F.col("cron_expr"), p)
    named = F.coalesce(F.col(f"{p}zone"), F.when(~F.col("timezone").isin("", "Local"), F.col("timezone")), F.lit("UTC"))
    df = settle(df, {f"{p}named": named})
    df = settle(df, {f"{p}zone_ok": valid_zone(f"{p}named")})
    mask = lambda c: F.expr(f"aggregate({p}{c}, 0L, (m, bit) -> m | shiftleft(1L, bit))")
    return df.select(
        f"{p}of",
        *[mask(c).alias(f"{p}{m}") for m, c in MASKS.items()],
        (F.col(f"{p}dom_star") | F.col(f"{p}dow_star")).alias(f"{p}both"),
        *[f"{p}{c}" for c in ("every", "ok", "named", "zone_ok")],
        # Rows with a bad zone are not converted; UTC keeps the expression total.
        F.when(F.col(f"{p}zone_ok"), F.col(f"{p}named")).otherwise("UTC").alias(f"{p}tz"),
    )


def with_next_run(
    df: DataFrame,
    schedule: str = "schedule",
    start: str = "from_time",
    out: str = "next_run_at",
    error: str = "schedule_error",
) -> DataFrame:
    """Add the first run of a schedule after a time, or why there is none.

    ``schedule`` is a struct (type, run_at, delay in nanoseconds, cron_expr, timezone). An unset
    time zone is UTC. A valid expression that does not fire within five years gives NULL without
    an error. ``df`` is read twice, once for the distinct expressions.
    """
    p = "_c_"
    fields = ("type", "run_at", "delay", "cron_expr", "timezone")
    df = settle(df, {f"{p}s_{name}": F.col(schedule)[name] for name in fields})
    s = {name: F.col(f"{p}s_{name}") for name in fields}
    kind, begin = s["type"], F.col(start)
    recurring = kind == "recurring"
    text = lambda c: F.coalesce(s[c], F.lit(""))
    # Rows that need no parsing get keys that match nothing and are spread over the tasks.
    spread = F.concat(F.lit("\x1e"), F.pmod(F.xxhash64(begin), F.lit(997)).cast("string"))
    df = settle(df, {f"{p}key": F.when(recurring, F.concat(text("timezone"), F.lit("\x1f"), text("cron_expr"))).otherwise(spread)})
    distinct = df.filter(recurring).select(F.col(f"{p}key").alias(f"{p}of"), text("cron_expr").alias("cron_expr"), text("timezone").alias("timezone")).distinct()
    masks = parsed_schedules(distinct, p)
    df = df.join(masks, F.col(f"{p}key") == F.col(f"{p}of"), "left")
    named = F.col(f"{p}named")
    df = _next_cron(df, begin, p, f"{p}cron_next")

    micros = F.unix_micros(begin)
    delayed = F.timestamp_micros(micros + F.floor(F.greatest(F.coalesce(s["delay"], F.lit(0)), F.lit(0)) / 1000))
    every = F.timestamp_micros(
        micros - F.pmod(micros, F.lit(1_000_000)) + F.floor(F.col(f"{p}every") / 1000).cast("bigint")
    )
    cron_missing = F.coalesce(s["cron_expr"], F.lit("")) == ""
    reason = (
        F.when(kind.isin("immediate", "delayed"), F.lit(None).cast("string"))
        .when(kind == "one_time", F.when(s["run_at"].isNull(), "run_at required"))
        .when(
            recurring,
            F.when(cron_missing, "cron_expr required for recurring")
            .when(~F.col(f"{p}zone_ok"), F.concat(F.lit("timezone: unknown time zone "), named))
            .when(~F.col(f"{p}ok"), F.concat(F.lit("cron_expr: invalid expression "), s["cron_expr"])),
        )
        .otherwise(F.concat(F.lit('unknown schedule type "'), F.coalesce(kind, F.lit("")), F.lit('"')))
    )
    df = settle(df, {error: reason})
    at = (
        F.when(F.col(error).isNotNull(), F.lit(None).cast("timestamp"))
        .when(kind == "immediate", begin)
        .when(kind == "delayed", delayed)
        .when(kind == "one_time", s["run_at"])
        .otherwise(F.coalesce(every, F.col(f"{p}cron_next")))
    )
    df = settle(df, {out: at})
    return df.drop(*[c for c in df.columns if c.startswith(p)])
