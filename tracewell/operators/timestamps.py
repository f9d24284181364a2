"""Time texts in many spellings and zones as one instant in UTC."""

from __future__ import annotations

import zoneinfo
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import pin

# Month names, spellings of times. Each spelling is rewritten to year-month-day and the rest.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MON = r"([A-Za-z]{3})[a-z]*\.?"
SPELLINGS = [
    (r"^(\d{4})(\d{2})(\d{2})[Tt ](\d{2})(\d{2})(\d{2})(.*)$", "$1-$2-$3 $4:$5:$6$7"),  # 20230304T153700Z
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})(?:,? +(.*))?$", "$3-$2-$1 $4"),  # 29.04.2023 09:59:40
    (r"^(?:[A-Za-z]{3}, )?(\d{1,2})[/ -]" + _MON + r"[/ -](\d{4})(?:[: ]+(.*))?$", "$3-$2-$1 $4"),  # 25/Apr/2023:13:26:39 +0545
    (r"^[A-Za-z]{3} " + _MON + r" +(\d{1,2}) (\d{1,2}:\d{2}(?::\d{2})?)((?: [A-Z]{2,5})?) (\d{4})$", "$5-$1-$2 $3$4"),  # Mon Jul  3 08:39:35 2023
    (r"^" + _MON + r" (\d{1,2}),? (\d{4})(?:,? +(.*))?$", "$3-$1-$2 $4"),  # Jul 28, 2023 1:03 AM
    (r"^(\d{4})年(\d{1,2})月(\d{1,2})日 *(.*)$", "$1-$2-$3 $4"),  # 2024年10月19日 05:48:38
]
PARTS = (
    r"^(\d{4})[-/.](\d{1,2}|[A-Za-z]{3})[-/.](\d{1,2})"
    r"(?:[Tt ]\s*(?:(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*(?:([AaPp][Mm])(?![A-Za-z]))?\s*(.*))?)?$"
)
OFFSET = r"^(?:UTC|GMT)?([+-])(\d{2}):?(\d{2})?(?:\[[^\]]*\])?$"
REGION = r"^\[?([A-Za-z][A-Za-z0-9_+-]*(?:/[A-Za-z0-9_+-]+)*)\]?$"
#: Years for which the abbreviations of a zone are looked up.
ABBREVIATION_YEARS = range(1990, 2038)


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def _local(us: Column) -> Column:
    return F.timestamp_micros(us)


def in_zone(us: Column, zone: Column) -> Column:
    """UTC microseconds of local microseconds in a zone. A local time that occurs twice means the first, a skipped one moves on by the skip."""
    return _micros(F.to_utc_timestamp(_local(us), zone))


def parse(df: DataFrame, text: str) -> DataFrame:
    """Adds what a time text says: _us (microseconds, local if the zone is still open), _offset (seconds; 0 for UTC), _region, _abbreviation.

    All are null for null, impossible dates and texts that are no time. A missing part of the time is zero, digits
    beyond microseconds are cut off. A number counts from 1970 in UTC, in seconds, milliseconds, microseconds or
    nanoseconds by its size.
    """
    rest = df.columns
    s = F.translate(F.regexp_replace(F.col(text), r"(?U)^\s+|\s+$", ""), "|", "?")
    number = F.when(s.rlike(r"^\d{1,19}(\.\d+)?$"), F.substring(F.regexp_replace(s, r"(\.\d{9})\d+$", "$1"), 1, 38).try_cast("decimal(38,9)"))
    scale = F.when(number < 10**11, 10**6).when(number < 10**14, 10**3).when(number < 10**17, 1).otherwise(0)
    counted = F.when(scale == 0, F.floor(number / 1000)).otherwise(F.floor(number * scale)).cast("bigint")
    for pattern, to in SPELLINGS:
        s = F.regexp_replace(s, pattern, to)
    df = df.withColumns({"_number_us": counted, "_s": s}).withColumn("_s", F.when(F.col("_number_us").isNull() & F.col("_s").rlike(PARTS), F.col("_s")))
    # one match for all parts: a missing one is an empty text
    df = df.withColumn("_part", F.split(F.regexp_replace("_s", PARTS, "|".join(f"${i}" for i in range(10))), r"\|", 10))
    part = [F.col("_part")[i] for i in range(10)]
    month = F.when(part[2].rlike(r"^\d"), part[2].try_cast("int")).otherwise(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part[2])))
    h, half = F.coalesce(part[4].try_cast("int"), F.lit(0)), F.upper(part[8])
    hour = F.when(half == "", h).when((h < 1) | (h > 12), None).otherwise(h % 12 + F.when(half == "PM", 12).otherwise(0))
    second = F.coalesce(part[6].try_cast("int"), F.lit(0))
    fraction = F.coalesce(F.rpad(F.substring(part[7], 1, 6), 6, "0").try_cast("bigint"), F.lit(0))
    minute = F.coalesce(part[5].try_cast("int"), F.lit(0))
    made = F.try_make_timestamp(part[1].try_cast("int"), month.cast("int"), part[3].try_cast("int"), hour, minute, second.cast("decimal(16,6)"), F.lit("UTC"))
    df = df.withColumns({"_us": F.coalesce("_number_us", _micros(made) + fraction), "_zone": F.trim(part[9])})
    zone = F.col("_zone")
    df = df.withColumn("_shift", F.when(zone.rlike(OFFSET), F.split(F.regexp_replace(zone, OFFSET, "$1|$2|$3"), r"\|")))
    hours, minutes = F.col("_shift")[1].cast("int"), F.coalesce(F.col("_shift")[2].try_cast("int"), F.lit(0))
    shift = F.when(F.col("_shift").isNotNull(), F.when(F.col("_shift")[0] == "-", -1).otherwise(1) * (hours * 3600 + minutes * 60))
    offset = F.when(F.col("_number_us").isNotNull() | F.upper(zone).isin("Z", "UTC", "GMT", "UT", "[UTC]"), 0).otherwise(shift).cast("bigint")
    named = F.regexp_extract(zone, REGION, 1)
    region = F.when(named.contains("/"), named)
    short = F.when((zone != "") & zone.rlike(r"^[A-Za-z]{2,5}$") & offset.isNull(), F.upper(zone))
    df = df.withColumns({"_offset": F.when(F.abs(offset) <= 18 * 3600, offset), "_region": region, "_abbreviation": short})
    known = (zone == "") | zone.isNull() | F.col("_offset").isNotNull() | F.col("_region").isNotNull() | F.col("_abbreviation").isNotNull()
    parsed = F.struct(F.when(known, F.col("_us")).alias("_us"), "_offset", "_region", "_abbreviation")
    # as a generator's output: else each later filter on a part would repeat the whole parsing below
    return df.select(*rest, F.inline(F.array(parsed)))


def known_regions() -> list[str]:
    return sorted(zoneinfo.available_timezones())


def abbreviations(zones: list[str]) -> dict[tuple[str, str], int]:
    """The offset that each zone shows under each of its abbreviations, the latest use if it changed."""
    found: dict[tuple[str, str], int] = {}
    for name in zones:
        zone = zoneinfo.ZoneInfo(name)
        for year in ABBREVIATION_YEARS:
            for month in range(1, 13):
                t = datetime(year, month, 15, tzinfo=UTC).astimezone(zone)
                short = t.tzname() or ""
                if short.isalpha():
                    found[name, short.upper()] = int((t.utcoffset() or timedelta()).total_seconds())
    return found


def _lookup(table: dict[str, int], key: Column) -> Column:
    if not table:
        return F.lit(None).cast("bigint")
    return F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])[key].cast("bigint")


def candidate_zones(registry: DataFrame, zone: str = "tz_name") -> list[str]:
    """The distinct zones of a registry that exist; there are some 600 zones in all."""
    known = set(known_regions())
    return sorted(r[0] for r in registry.select(zone).distinct().collect() if r[0] in known)


def zone_classes(first: int, last: int, preferred: list[str]) -> list[str]:
    """One zone for each history of offsets that some zone has between two years; of zones that share one a preferred one, then the first by name."""
    days = [datetime(y, m, d, tzinfo=UTC) for y in range(first, last + 1) for m in range(1, 13) for d in (3, 12, 21, 29)[: 4 if m != 2 else 3]]
    chosen: dict[tuple, str] = {}
    for name in [*preferred, *known_regions()]:
        zone = zoneinfo.ZoneInfo(name)
        chosen.setdefault(tuple(d.astimezone(zone).utcoffset() for d in days), name)
    return sorted({*chosen.values(), *preferred})


def order_evidence(df: DataFrame, first: str, last: str, machine: str) -> DataFrame:
    """What two times of one record tell of a machine's zone, if one has a zone and the other has not: (_m, _us, _in, _bound), local and known microseconds, and whether the known one must be later (1) or earlier (-1)."""
    rows = parse(df.select(F.col(machine).alias("_m"), F.col(first).alias("_first"), F.col(last).alias("_last")), "_first")
    rows = rows.select("_m", "_last", F.col("_us").alias("_a"), F.col("_offset").alias("_ao"), (F.col("_region").isNull() & F.col("_abbreviation").isNull()).alias("_ak"))
    rows = parse(rows, "_last").filter("_ak and _region is null and _abbreviation is null and _m is not null and _a is not null and _us is not null")
    early = F.when(F.col("_ao").isNull() & F.col("_offset").isNotNull(), F.struct(F.col("_a").alias("_us"), (F.col("_us") - F.col("_offset") * 1000000).alias("_in"), F.lit(1).alias("_bound")))
    late = F.when(F.col("_ao").isNotNull() & F.col("_offset").isNull(), F.struct(F.col("_us").alias("_us"), (F.col("_a") - F.col("_ao") * 1000000).alias("_in"), F.lit(-1).alias("_bound")))
    return rows.select("_m", F.coalesce(early, late).alias("_e")).filter("_e is not null").select("_m", "_e.*")


def estimate_zones(
    df: DataFrame,
    text: str,
    machine: str,
    ingested: str,
    registry: DataFrame,
    zones: list[str] | None = None,
    declared_weight: float = 0.15,
    lag: tuple[int, int] | None = None,
    ordered: list[DataFrame] | None = None,
) -> DataFrame:
    """The zone of each machine whose offset history has the fewest violations: machine, zone, declared, n_evidence, n_violations.

    Evidence are the machine's time texts. One with an offset violates a zone that had another offset at that instant. One
    without is converted in each candidate zone and violates those in which it would have been ingested (epoch seconds)
    earlier or later after its writing than texts with zones are (`lag`: from their 1st and 99th percentile, if not
    given); `ordered` (of order_evidence()) are local times that violate zones in which they would come on the wrong side
    of a known instant. Candidates are one zone for each history of offsets in the years of the evidence, all zones of
    the registry among them. A zone that the registry declares (machine_id, tz_name) is one more witness: another must
    have fewer violations by more than declared_weight of the evidence, and by more than 3. A machine in neither the
    registry nor the evidence has no row; equal zones go by name.

    Evidence is counted by machine, hour and five minutes of lag before it meets the candidates, so what is multiplied
    by zones grows with the hours that the texts span and not with their number; and only machines whose declared zone has
    more violations than that doubt, or which have none declared, meet more than the declared one.
    """
    known = registry.select(F.col("machine_id").alias("_m"), F.col("tz_name").alias("declared")).dropDuplicates(["_m"])
    rows = parse(df.select(F.col(text).alias("_text"), F.col(machine).alias("_m"), F.col(ingested).alias("_in")), "_text")
    rows = rows.filter(F.col("_m").isNotNull() & F.col("_us").isNotNull() & F.col("_region").isNull() & F.col("_abbreviation").isNull())
    rows = rows.select("_m", "_us", F.col("_offset").alias("_shown"), (F.col("_in") * 1000000).alias("_in"), F.lit(0).alias("_bound"))
    for more in ordered or []:
        rows = rows.unionByName(more.select("_m", "_us", F.lit(None).cast("bigint").alias("_shown"), "_in", "_bound"))
    hour, step = 3_600_000_000, 300_000_000
    counted = rows.groupBy("_m", "_shown", "_bound", F.floor(F.col("_us") / hour).alias("_hour"), F.floor((F.col("_in") - F.col("_us")) / step).alias("_lag"))
    counted = pin(counted.agg(F.count(F.lit(1)).alias("_w")), "zone-evidence")
    shown, local = F.col("_shown"), F.col("_hour") * hour + hour // 2
    span = counted.agg(F.min(F.year(_local(local))), F.max(F.year(_local(local)))).first()
    if lag is None:
        behind = F.when(shown.isNotNull(), (F.col("_lag") * step + step // 2) / 1000000 + shown)
        found = counted.agg(F.percentile(behind, [0.01, 0.99], F.col("_w"))).first()[0] or [0, 0]
        lag = (min(0, int(found[0])), int(found[1]) + 1)
    if zones is None:
        zones = zone_classes(span[0] or 2020, span[1] or 2020, candidate_zones(registry))

    def broken(zone: Column) -> Column:
        instant = local - shown * 1000000
        offset = (_micros(F.from_utc_timestamp(_local(instant), zone)) - instant) / 1000000
        behind = (F.col("_lag") * step + step // 2 + local - in_zone(local, zone)) / 1000000
        wrong = F.when(F.col("_bound") == 0, ~behind.between(lag[0] - 300, lag[1] + 300)).otherwise(behind * F.col("_bound") < -300)
        return F.coalesce(F.when(shown.isNull(), wrong).otherwise((shown != 0) & (offset != shown)), F.lit(False))

    def violations(rows: DataFrame, zone: str, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.sum("_w").alias("n_evidence"), F.sum(F.when(broken(F.col(zone)), F.col("_w")).otherwise(0)).alias("n"))

    there = known.filter(F.col("declared").isin(known_regions()))
    sure = violations(counted.join(there, "_m"), "declared", "_m", "declared").withColumn("_doubt", F.greatest(F.lit(3), F.col("n_evidence") * declared_weight))
    # a declared zone with so few violations stays, whatever the others have
    kept = pin(sure, "declared-zones")
    open_rows = counted.join(kept.filter("n <= _doubt").select("_m"), "_m", "left_anti").withColumn("_z", F.explode(F.array(*map(F.lit, zones))))
    least = violations(open_rows, "_z", "_m", "_z").groupBy("_m").agg(F.max("n_evidence").alias("_all"), F.min(F.struct("n", F.col("_z").alias("zone"))).alias("_least"))
    both = known.join(kept.drop("declared"), "_m", "full").join(least, "_m", "full")
    stays = F.col("n").isNotNull() & (F.col("_least").isNull() | (F.col("n") <= F.col("_least")["n"] + F.col("_doubt")))
    quiet = F.col("_least").isNull() & F.col("n").isNull()  # no evidence: what is declared, if there is such a zone
    zone = F.when(stays | quiet, F.when(F.col("declared").isin(known_regions()), F.col("declared"))).otherwise(F.col("_least")["zone"])
    n = F.when(stays, F.col("n")).when(quiet, F.when(zone.isNotNull(), 0)).otherwise(F.col("_least")["n"])
    return both.select(F.col("_m").alias(machine), zone.alias("zone"), "declared", F.coalesce("n_evidence", "_all", F.lit(0)).alias("n_evidence"), n.alias("n_violations"))


def to_utc(df: DataFrame, text: str, machine: str, zones: DataFrame, out: str = "utc_us") -> DataFrame:
    """Adds the instant of a time text in microseconds since 1970 UTC; null where the text denotes none.

    What the text says of its zone decides, an abbreviation as used in the machine's zone (elsewhere if all zones that
    have it agree); else it is local time in the machine's zone of `zones` (machine, zone: of estimate_zones()). A text
    without a zone has no instant where the machine is null or unknown. The zones are joined by the machine; written as
    a table before, their size decides whether they are broadcast.
    """
    per_machine = zones.select(F.col(machine).alias("_machine"), F.col("zone").alias("_machine_zone")).filter(F.col("_machine").isNotNull())
    names = candidate_zones(per_machine, "_machine_zone")
    short = abbreviations(names)
    every: dict[str, set[int]] = {}
    for (_, a), offset in short.items():
        every.setdefault(a, set()).add(offset)
    agreed = {a: next(iter(o)) for a, o in every.items() if len(o) == 1}
    regions = df.sparkSession.createDataFrame([(z,) for z in known_regions()], "_known string")
    df = parse(df.drop(out), text).join(per_machine, F.col(machine) == F.col("_machine"), "left")
    df = df.join(F.broadcast(regions), F.col("_region") == F.col("_known"), "left")  # some 600 names
    by_zone = _lookup({f"{z}|{a}": o for (z, a), o in short.items()}, F.concat_ws("|", "_machine_zone", "_abbreviation"))
    offset = F.coalesce("_offset", by_zone, _lookup(agreed, F.col("_abbreviation")))
    us = F.col("_us")
    bare = F.col("_region").isNull() & F.col("_abbreviation").isNull()
    instant = (
        F.when(offset.isNotNull(), us - offset * 1000000)
        .when(F.col("_known").isNotNull(), in_zone(us, F.col("_known")))
        .when(bare & F.col("_machine_zone").isNotNull(), in_zone(us, F.col("_machine_zone")))
    )
    return df.withColumn(out, instant).drop("_us", "_offset", "_region", "_abbreviation", "_machine", "_machine_zone", "_known")


def normalise_columns(columns: list[tuple[str, DataFrame, str, str]], zones: DataFrame, machine: str = "machine_id") -> DataFrame:
    """One row for each value that denotes an instant, of several columns: table_name, record_key, field, utc_us.

    columns: (table name, table, key, field) each. Repeated rows give one row.
    """
    zones = pin(zones, "machine-zones")
    parts = [
        df.select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("record_key"), F.lit(field).alias("field"), F.col(field).alias("_value"), F.col(machine).alias("_by"))
        for name, df, key, field in columns
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    done = to_utc(every.filter(F.col("_value").isNotNull() & F.col("record_key").isNotNull()), "_value", "_by", zones.withColumnRenamed(machine, "_by"))
    return done.filter(F.col("utc_us").isNotNull()).select("table_name", "record_key", "field", "utc_us").distinct()
