"""Nested JSON exports to five row sets, with units, bounds and data-quality side outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.functions.clock import parse_instant
from vitalgrid.functions.text import with_canonical_type
from vitalgrid.schema import conversions, registry

UUID = "^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"


def files(spark: SparkSession, path: str | list[str], pattern: str = "*.json", most_bytes: int = 32 << 20) -> DataFrame:
    """(path, body) of the files of a folder or of several folders and files, those over ``most_bytes`` left out before they are read.

    A file that several paths lead to comes once; a path that leads to nothing raises.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    if not isinstance(path, str) and len(path) > 1:
        found = found.dropDuplicates(["path"])
    return found.filter(F.col("length") <= most_bytes).select("path", F.col("content").cast("string").alias("body"))


def parsed(bodies: DataFrame, body: str = "body") -> DataFrame:
    """``bodies`` with ``v``, the body as a VARIANT (null where it is no JSON): parsed once, all fields are read out of it. A ``v`` that is there stays."""
    return bodies if "v" in bodies.columns else bodies.withColumn("v", F.try_parse_json(body))


def status(bodies: DataFrame, body: str = "body") -> DataFrame:
    """``bodies`` with ``v`` and ``status``: ok, or bad where the body is no JSON object. A bad file stops nothing."""
    return parsed(bodies, body).withColumn("status", F.when(F.col("v").isNotNull() & F.col(body).rlike(r"^\s*\{"), "ok").otherwise("bad"))


def _get(point: str, key: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get({point}, '$.{key}', '{kind}')")


def _array(of: str, key: str) -> Column:
    """An array's elements as VARIANTs; null for anything else."""
    return _get(of, key, "array<variant>")


def metric_points(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(seq columns of ``bodies``, name, units, pos, point): every point of every named metric."""
    b = parsed(bodies, body)
    m = b.select("*", F.posexplode(_array("v", "data.metrics")).alias("_mp", "_m")).drop(body, "v")
    m = m.withColumns({"name": _get("_m", "name"), "units": _get("_m", "units")}).filter(F.col("name") != "")
    return m.select("*", F.posexplode(_array("_m", "data")).alias("_pp", "point")).drop("_m").withColumn("pos", F.struct("_mp", "_pp")).drop("_mp", "_pp")


def samples(points: DataFrame) -> DataFrame:
    """Metric rows from points, a point's own unit before its metric's: min/avg/max where such a key is present, even if null, else qty. Bad times go; bounds are not yet applied."""
    present = lambda k: F.expr(f"variant_get(point, '$.{k}')").isNotNull()  # noqa: E731 - a JSON null is there
    ranged = present("Min") | present("Avg") | present("Max")
    value = lambda k, on: F.when(on, _get("point", k, "double"))
    return points.filter("name <> 'sleep_analysis'").select(
        *[c for c in points.columns if c not in ("name", "units", "point")],
        parse_instant(_get("point", "date")).alias("time"), F.col("name").alias("metric"), F.coalesce(_get("point", "source"), F.lit("")).alias("source"), F.coalesce(F.nullif(_get("point", "units"), F.lit("")), "units").alias("unit"),
        value("qty", ~ranged).alias("qty"), value("Min", ranged).alias("vmin"), value("Avg", ranged).alias("vavg"), value("Max", ranged).alias("vmax"),
    ).filter("time is not null")


def normalise_units(rows: DataFrame, values: tuple[str, ...] = ("qty", "vmin", "vavg", "vmax")) -> DataFrame:
    """Values in each metric's own unit. Unknown metrics pass; an unknown conversion keeps its unit and sets ``flagged``."""
    spark = rows.sparkSession
    spec = registry(spark).select("metric", F.col("unit").alias("_canon"))
    df = rows.join(F.broadcast(spec), "metric", "left")
    conv = conversions(spark).select(F.col("from_unit").alias("_f"), F.col("to_unit").alias("_t"), F.col("factor").alias("_x"))
    df = df.join(F.broadcast(conv), (F.col("unit") == F.col("_f")) & (F.col("_canon") == F.col("_t")), "left")
    differs = F.col("_canon").isNotNull() & F.col("unit").isNotNull() & (F.col("unit") != F.col("_canon"))
    out = {v: F.when(F.col("_x").isNotNull(), F.col(v) * F.col("_x")).otherwise(F.col(v)) for v in values}
    out |= {"flagged": differs & F.col("_x").isNull(), "unit": F.when(differs & F.col("_x").isNull(), F.col("unit")).otherwise(F.coalesce("_canon", "unit", F.lit("")))}
    return df.withColumns(out).drop("_canon", "_f", "_t", "_x")


def plausible(rows: DataFrame) -> DataFrame:
    """``rows`` with ``implausible``: the representative value lies outside its metric's bounds (inclusive). Null, NaN, unknown and flagged pass."""
    spec = registry(rows.sparkSession).select("metric", "least", "most")
    value = F.coalesce("vavg", "qty")
    outside = F.coalesce(value < F.col("least"), F.lit(False)) | F.coalesce(value > F.col("most"), F.lit(False))
    bad = outside & ~F.isnan(F.coalesce(value, F.lit(0.0))) & ~F.coalesce(F.col("flagged"), F.lit(False))
    return rows.join(F.broadcast(spec), "metric", "left").withColumn("implausible", bad).drop("least", "most")


def sleep_rows(points: DataFrame) -> DataFrame:
    """Sleep sessions; a start is required. The date is that of the payload, in its own offset."""
    hours = {"total_sleep_h": "totalSleep", "deep_h": "deep", "core_h": "core", "rem_h": "rem", "awake_h": "awake", "asleep_h": "asleep", "in_bed_h": "inBed"}
    return points.filter("name = 'sleep_analysis'").select(
        *[c for c in points.columns if c not in ("name", "units", "point")],
        *[parse_instant(_get("point", k)).alias(a) for a, k in (("sleep_start", "sleepStart"), ("sleep_end", "sleepEnd"), ("in_bed_start", "inBedStart"), ("in_bed_end", "inBedEnd"))],
        F.coalesce(_get("point", "source"), F.lit("")).alias("source"), F.substring(_get("point", "date"), 1, 10).try_cast("date").alias("sleep_date"),
        *[_get("point", k, "double").alias(a) for a, k in hours.items()],
    ).filter("sleep_start is not null")


def _quantity(key: str) -> Column:
    """Of ``{qty, units}`` or a bare number."""
    return F.coalesce(_get("w", f"{key}.qty", "double"), _get("w", key, "double"))


def _energy(key: str) -> Column:
    return F.when(_get("w", f"{key}.units") == "kJ", _quantity(key) * 0.2390057361).otherwise(_quantity(key))


def _strange_energy(key: str) -> Column:
    """1 where an energy has a quantity and a unit that is neither kJ nor kcal, else 0; no or an empty unit is kcal."""
    unit = F.nullif(_get("w", f"{key}.units"), F.lit(""))
    return (_get("w", f"{key}.qty", "double").isNotNull() & F.coalesce(~unit.isin("kJ", "kcal"), F.lit(False))).cast("int")


def workouts(bodies: DataFrame, body: str = "body", type_map: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(workouts, dropped): sessions with a valid UUID, and id and name of the others. ``w`` holds the session as a VARIANT, ``energy_flags``
    how many of its two energies are in an unknown unit.
    """
    b = parsed(bodies, body)
    w = b.select("*", F.posexplode(_array("v", "data.workouts")).alias("pos", "w")).drop(body, "v")
    w = w.withColumns({"hae_id": F.lower(_get("w", "id")), "name": _get("w", "name")})
    good = F.coalesce(F.col("hae_id").rlike(UUID), F.lit(False))
    flat = F.regexp_replace("hae_id", "-", "")
    canonical = F.concat_ws("-", *[F.substring(flat, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    rows = w.filter(good).withColumns({
        "hae_id": canonical, "start_time": parse_instant(_get("w", "start")), "end_time": parse_instant(_get("w", "end")), "location": _get("w", "location"),
        "is_indoor": _get("w", "isIndoor", "boolean"), "duration_s": _get("w", "duration", "double"), "total_energy_kcal": _energy("totalEnergy"), "active_energy_kcal": _energy("activeEnergyBurned"),
        "energy_flags": _strange_energy("totalEnergy") + _strange_energy("activeEnergyBurned"),
        "distance_km": _quantity("distance"), "avg_hr": _quantity("heartRate.avg"), "max_hr": _quantity("heartRate.max"), "intensity": _quantity("intensity"),
        "elevation_up_m": _quantity("elevationUp"), "temperature_c": _quantity("temperature"), "humidity_pct": _quantity("humidity"), "source": _get("w", "source"),
    })
    return with_canonical_type(rows, type_map), w.filter(~good).select("hae_id", "name")


def _origin(sessions: DataFrame) -> list[str]:
    return [c for c in ("_path", "pos") if c in sessions.columns]


def _seq(points: DataFrame) -> Column:
    """Where a point stood: file, session, place. Of two points with one key the later one counts, in every run."""
    return F.struct(*_origin(points), "at").alias("seq")


def hr_samples(sessions: DataFrame) -> DataFrame:
    """(workout, ts, bpm): the average if there, else the quantity; both time and value are needed."""
    p = sessions.select("hae_id", *_origin(sessions), F.posexplode(_array("w", "heartRateData")).alias("at", "p"))
    bpm = F.coalesce(_get("p", "Avg", "double"), _get("p", "qty", "double"))
    return p.select(F.col("hae_id").alias("workout_hae_id"), parse_instant(_get("p", "date")).alias("ts"), bpm.alias("bpm"), _seq(p)).dropna(subset=["ts", "bpm"])


def route_points(sessions: DataFrame) -> DataFrame:
    p = sessions.select("hae_id", *_origin(sessions), F.posexplode(_array("w", "route")).alias("at", "p"))
    first = lambda a, b: F.coalesce(_get("p", a, "double"), _get("p", b, "double"))
    rows = p.select(F.col("hae_id").alias("workout_hae_id"), parse_instant(_get("p", "timestamp")).alias("ts"), first("latitude", "lat").alias("lat"), first("longitude", "lon").alias("lon"), _get("p", "altitude", "double").alias("altitude_m"), _get("p", "speed", "double").alias("speed_mps"), _seq(p))
    return rows.dropna(subset=["ts", "lat", "lon"])


def unregistered(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Stub registry rows of unknown metrics: first unit seen, aggregate sum, secondary."""
    new = rows.join(known.select("metric"), "metric", "left_anti").groupBy("metric").agg(F.min_by("unit", "pos").alias("unit"))
    return new.select("metric", F.coalesce("unit", F.lit("")).alias("unit"), F.lit("sum").alias("agg"), F.lit(None).cast("string").alias("category"), F.lit("secondary").alias("tier"))
