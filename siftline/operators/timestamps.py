"""Mixed time texts to one unambiguous instant.

A cascade of anchored patterns turns each text into its parts; the first that fits decides. A zone
or offset in the text counts first (abbreviations as the default zone uses them), then the default
zone of the source. A local time that its zone skipped or had twice, an impossible date, a text
without date or time of day, and a local time of unknown zone have no instant (null). All in
built-in expressions; only the lookup of zones is read on the driver.

Null and empty texts have no instant; blanks around a text don't count.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.runtime import collect_small, small

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MON, _DOW = "(" + "|".join(MONTHS) + ")", "(?:mon|tue|wed|thu|fri|sat|sun),?"
_HMS, _ZONE = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?", r"(?:[ ]?(z|[+-]\d{2}:?\d{2}|[a-z]{2,5}))?"
#: Anchored patterns (on lower-case text) and how their groups make year|month|day|hour|minute|second|fraction|zone|half of day.
#: An empty year is inferred from the time of arrival; slashed dates have two readings.
CASCADE: tuple[tuple[str, str], ...] = (
    (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})[t_ ]{_HMS}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|"),
    (rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})[t_ ]{_HMS}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|"),
    (rf"^{_MON} +(\d{{1,2}}) {_HMS}$", "|$1|$2|$3|$4|$5|$6||"),
    (rf"^{_DOW} {_MON} +(\d{{1,2}}) {_HMS}(?: ([a-z]{{1,5}}))? (\d{{4}})$", "$8|$1|$2|$3|$4|$5|$6|$7|"),
    (rf"^(\d{{1,2}})/{_MON}/(\d{{4}}):{_HMS}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|"),
    (rf"^(\d{{2}})(\d{{2}}) (\d{{2}}):(\d{{2}}):(\d{{2}})\.(\d{{1,9}})$", "|$1|$2|$3|$4|$5|$6||"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}})[ _t]{_HMS}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|"),
    (rf"^(?:{_DOW} )?(\d{{1,2}}) {_MON} (\d{{4}}) {_HMS}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|"),
    (rf"^{_MON} +(\d{{1,2}}), (\d{{4}}) {_HMS} ?([ap])m$", "$3|$1|$2|$4|$5|$6|$7||$8"),
    (r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1|$2|$3|$4|$5|$6|||"),
)
SLASHED = rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}})[ _t]{_HMS}{_ZONE}$"
EPOCH = r"^\d{10}(\.\d{1,9})?$|^\d{13}$"
_DAY = 86_400_000_000


def abbreviations(zones: list[str], first: int = 1990, last: int = 2040) -> dict[str, dict[str, int]]:
    """Offsets in seconds of the abbreviations each zone uses; those used with two offsets are left out."""
    out = {}
    for name in zones:
        zone, seen = ZoneInfo(name), {}
        at = datetime(first, 1, 1, tzinfo=timezone.utc)
        while at.year <= last:
            local = at.astimezone(zone)
            seen.setdefault(local.tzname().lower(), set()).add(int(local.utcoffset().total_seconds()))
            at += timedelta(days=20)
        out[name] = {k: v.pop() for k, v in seen.items() if len(v) == 1 and k.isalpha()}
    return out


def zone_table(lookup: DataFrame, key: str, *more: str) -> DataFrame:
    """``key``, ``_tz`` (null where unknown), ``_abbr`` (offsets by abbreviation) and further columns of a lookup table."""
    names = [r[0] for r in collect_small(lookup.select("tz_name").where("tz_name is not null").distinct(), 2000)]
    known = {}
    for n in names:
        try:
            known[n] = abbreviations([n])[n]
        except (KeyError, ValueError, OSError):
            continue  # no such zone: unknown
    spark = lookup.sparkSession
    zones = spark.createDataFrame([(n, a) for n, a in known.items()], "tz_name string, _abbr map<string,int>")
    one = lookup.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("tz_name", *more)).alias("l")).select(key, "l.*")
    return one.join(F.broadcast(zones.withColumn("_tz", F.col("tz_name"))), "tz_name", "left").select(key, "_tz", "_abbr", *more)  # at most as many rows as there are zones


def with_instant(df: DataFrame, text: str, received: str = "received_at", out: str = "epoch_us") -> DataFrame:
    """Add ``out``: microseconds since 1970 UTC. ``df`` has _tz, _abbr and _day_first beside its own columns."""
    t = F.lower(F.regexp_replace(F.col(text), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    df = df.withColumn("_t", t)
    parts = F.when(F.col("_t").rlike(EPOCH), F.lit(None).cast("string"))
    for pattern, groups in CASCADE:
        parts = parts.when(F.col("_t").rlike(pattern), F.regexp_replace("_t", pattern, groups))
    day = F.regexp_replace("_t", SLASHED, "$3|$2|$1|$4|$5|$6|$7|$8|")
    month = F.regexp_replace("_t", SLASHED, "$3|$1|$2|$4|$5|$6|$7|$8|")
    parts = parts.when(F.col("_t").rlike(SLASHED) & F.col("_day_first").isNotNull(), F.when(F.col("_day_first"), day).otherwise(month))
    df = df.withColumn("_p", F.split(parts, r"\|"))
    part = lambda i: F.when(F.size("_p") == 9, F.get("_p", F.lit(i)))
    number = lambda i: F.try_to_number(F.nullif(part(i), F.lit("")), F.lit("9999")).cast("int")
    mon = part(1)
    month_no = F.when(mon.rlike(r"^\d+$"), number(1))
    for i, m in enumerate(MONTHS):
        month_no = month_no.when(mon == m, i + 1)
    hour = number(3)
    half = part(8)
    hour = F.when(half == "", F.when(hour <= 23, hour)).when((hour >= 1) & (hour <= 12), F.pmod(hour, F.lit(12)) + F.when(half == "p", 12).otherwise(0))
    second = F.coalesce(number(5), F.lit(0))
    micros = F.rpad(F.substring(part(6), 1, 6), 6, "0").cast("bigint")
    df = df.select("*", number(0).alias("_y"), month_no.alias("_mo"), number(2).alias("_d"), part(7).alias("_z"), F.when((number(4) <= 59) & (second <= 59), (hour * 3600 + number(4) * 60 + second).cast("bigint") * 1_000_000 + micros).alias("_tod"))
    # without a year: the latest one that is not after the arrival; of a local time that came twice, the first counts here
    local = F.from_utc_timestamp(F.col(received), F.col("_tz"))
    wall = lambda y: F.unix_date(F.try_make_timestamp_ntz(y, F.col("_mo"), F.col("_d"), F.lit(0), F.lit(0), F.lit(0)).cast("date")).cast("bigint") * _DAY + F.col("_tod")
    there = lambda y: F.to_utc_timestamp(F.timestamp_micros(wall(y)), F.col("_tz")) <= F.col(received)
    latest = F.coalesce(*[F.when(there(F.year(local) - k), F.year(local) - k) for k in (0, 1)])
    fourth = F.year(local) - F.pmod(F.year(local), F.lit(4))
    leap = F.when(there(fourth), fourth).otherwise(fourth - 4)
    inferred = F.when((F.col("_mo") == 2) & (F.col("_d") == 29), leap).otherwise(latest)
    year = F.when(F.col("_y").isNull(), F.when(part(0) == "", inferred)).when(F.length(part(0)) == 2, F.col("_y") + 2000).otherwise(F.col("_y"))
    df = df.withColumn("_n", wall(year))
    z = F.col("_z")
    hours, minutes = F.substring(z, 2, 2).cast("int"), F.substring(z, -2, 2).cast("int")
    offset = (
        F.when(z.isin("z", "utc", "gmt"), 0)
        .when(z.rlike(r"^[+-]\d{2}:?\d{2}$"), F.when((hours <= 18) & (minutes <= 59), (hours * 3600 + minutes * 60) * F.when(z.startswith("-"), -1).otherwise(1)))
        .when(z != "", F.try_element_at("_abbr", z))
    )
    n, tz = F.col("_n"), F.col("_tz")
    at = lambda us: F.timestamp_micros(us)
    to_local = lambda us: F.unix_micros(F.from_utc_timestamp(at(us), tz))
    # the offsets a day before and after bracket any change of clocks: each gives a candidate, which holds if it maps back
    df = df.withColumn("_early", n - (to_local(n - _DAY) - (n - _DAY))).withColumn("_late", n - (to_local(n + _DAY) - (n + _DAY)))
    early, late = F.col("_early"), F.col("_late")
    df = df.withColumn("_ok_early", to_local(early) == n).withColumn("_ok_late", to_local(late) == n)
    ok_early, ok_late = F.col("_ok_early"), F.col("_ok_late")
    zoned = F.when(early == late, F.when(ok_early, early)).when(ok_early & ~ok_late, early).when(ok_late & ~ok_early, late)
    text_us = F.when(z == "", F.when(tz.isNotNull(), zoned)).otherwise(n - offset.cast("bigint") * 1_000_000)
    seconds = F.substring("_t", 1, 10).cast("bigint") * 1_000_000
    digits = F.when(F.length("_t") == 13, F.when(~F.col("_t").contains("."), F.col("_t").cast("bigint") * 1000).otherwise(seconds + F.rpad(F.substring("_t", 12, 6), 6, "0").cast("bigint"))).when(F.length("_t") == 10, seconds).otherwise(seconds + F.rpad(F.substring("_t", 12, 6), 6, "0").cast("bigint"))
    return df.withColumn(out, F.when(F.col("_t").rlike(EPOCH), digits).otherwise(text_us)).drop("_t", "_p", "_y", "_mo", "_d", "_z", "_tod", "_n", "_early", "_late", "_ok_early", "_ok_late")


def instants(syslog: DataFrame, hosts: DataFrame, mdl: DataFrame, feeds: DataFrame) -> DataFrame:
    """``table_name``, ``row_id``, ``epoch_us`` of the time texts of both tables that fit one instant.

    A repeated id counts once, by its first arrival (of those with an instant).
    """
    log = syslog.where("date is not null").select(F.col("line_id").alias("row_id"), "host", "received_at", "date")
    log = log.join(small(zone_table(hosts, "host")), "host", "left").withColumn("_day_first", F.lit(None).cast("boolean"))
    feed = mdl.where("date is not null").select("row_id", "feed_id", "received_at", "date")
    feed = feed.join(small(zone_table(feeds, "feed_id", "day_first")), "feed_id", "left").withColumnRenamed("day_first", "_day_first")
    parts = []
    for name, df in (("syslog", log), ("mdl_data", feed)):
        # the filter follows the aggregate: pushed below, it would repeat the whole cascade in its condition
        got = with_instant(df.where("row_id is not null"), "date")
        got = got.groupBy("row_id").agg(F.min(F.when(F.col("epoch_us").isNotNull(), F.struct("received_at", "epoch_us"))).alias("s")).where("s is not null")
        parts.append(got.select(F.lit(name).alias("table_name"), "row_id", F.col("s.epoch_us").alias("epoch_us")))
    return parts[0].union(parts[1])
