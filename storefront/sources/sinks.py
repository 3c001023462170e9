"""Sinks: publication of units of work as a change log (S3) and the archive.

A unit of work changes several tables at once (e.g. payments and orders). Each
changed table's rows are written as a run below ``root/<table>/run=<n>``; then
one small file, ``root/state/current.json``, is replaced by an atomic rename, so
readers see either every change of the unit or none. That file is the only
pointer: it names the newest version, each table's base and its live runs, and
nothing else is listed or read to find them.

Runs are compacted in tiers by size: when FANOUT of the newest runs lie in one
tier or below, they are merged (latest row per key) into one run, published like
a unit. A table has at most FANOUT - 1 runs a tier, so a reader opens a number of
files that grows with the logarithm of the log, and it opens them as one
partitioned dataset (partition column ``run``, whose order is the order of the
versions): the plan has one scan of the log however many versions there are.
``compact`` folds the log into a new base.

Bases can be bucketed (``start_log``): rows lie in ``buckets`` buckets by a hash of
one column, and ``rows_for`` reads, for a set of keys, only the buckets they fall
into, joined without a shuffle of the base.

Units are published by one writer, in ascending version order. Paths must be on a
shared file system (the same place spark.checkpoint.dir points to on a cluster).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storefront.sources.layout import BUCKET, bucket_of, open_bucketed, save_by_bucket
from storefront.sources.schemas import PRIMARY_KEYS

#: Runs of one tier that are merged into one; a tier holds sizes up to FANOUT times the tier below.
FANOUT = 8
#: Sizes up to this many bytes are the lowest tier.
SMALL_RUN = 1 << 20
RUN = "run"


# ---------------------------------------------------------------- the pointer

def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of the Hadoop API: any store Spark can write to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _bytes_below(spark: SparkSession, path: str) -> int:
    fs, p = _hadoop(spark, path)
    return int(fs.getContentSummary(p).getLength())


def _pointer(root: str) -> str:
    return f"{root.rstrip('/')}/state/current.json"


def newest_manifest(spark: SparkSession, root: str) -> dict | None:
    """The state as of the newest version; None before the first one. Any other
    failure than a missing pointer is the caller's."""
    try:
        row = spark.read.text(_pointer(root), wholetext=True).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return json.loads(row[0])


def is_published(spark: SparkSession, root: str, version: int) -> bool:
    """Whether unit ``version`` was published (a replayed batch is then done)."""
    state = newest_manifest(spark, root)
    return state is not None and version <= state["version"]


def _publish(spark: SparkSession, root: str, state: dict) -> str:
    """Replace the pointer: the new state is written beside it and renamed over it."""
    path = _pointer(root)
    fs, target = _hadoop(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
    out.close()
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, options)
    return path


def _empty_state() -> dict:
    return {"version": -1, "next_run": 0, "tables": {}, "bases": {}, "log": {}, "keys": {}, "schemas": {}}


# ---------------------------------------------------------------- writing

def _write_run(df: DataFrame, root: str, name: str, state: dict, version: int, partition_by: list[str] | None = None) -> dict:
    """Write rows as the next run; rows of a bucketed table carry their bucket,
    sorted by it, so that a reader of few buckets skips row groups."""
    run, base = state["next_run"], state["bases"].get(name) or {}
    state["next_run"] += 1
    path = f"{root}/{name}/{RUN}={run}"
    if base.get("buckets"):
        df = df.withColumn(BUCKET, bucket_of(base["by"], base["buckets"])).sortWithinPartitions(BUCKET)
    state["schemas"][name] = df.schema.json()
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return {"run": run, "path": path, "bytes": _bytes_below(df.sparkSession, path), "version": version}


def write_snapshot(changed: Mapping[str, DataFrame], root: str, version: int,
                   partition_by: Mapping[str, list[str]] | None = None,
                   keys: Mapping[str, str | list[str]] | None = None) -> str:
    """S3: write every changed table as a run and publish them together by one
    new pointer. Returns the pointer's path. A version not above the published
    one is refused. ``keys``: the key columns by which a table's runs are merged,
    if not its primary key."""
    if not changed:
        raise ValueError("nothing to publish")
    spark = next(iter(changed.values())).sparkSession
    root = root.rstrip("/")
    state = newest_manifest(spark, root) or _empty_state()
    if version <= state["version"]:
        raise ValueError(f"version {version} is already published")
    for name, df in changed.items():
        run = _write_run(df, root, name, state, version, (partition_by or {}).get(name))
        state["tables"][name] = run["path"]
        state["log"].setdefault(name, []).append(run)
        key = (keys or {}).get(name) or state["keys"].get(name) or PRIMARY_KEYS.get(name)
        if key is not None:
            state["keys"][name] = [key] if isinstance(key, str) else list(key)
    state["version"] = version
    path = _publish(spark, root, state)
    _merge_tiers(spark, root, state, [n for n in changed if n in state["keys"]])
    return path


def _tier(size: int) -> int:
    tier = 0
    while size > SMALL_RUN * FANOUT ** tier:
        tier += 1
    return tier


def _due(log: list[dict]) -> int:
    """How many of the newest runs are to be merged now (0: none)."""
    if not log:
        return 0
    top, n = _tier(log[-1]["bytes"]), 0
    for run in reversed(log):
        if _tier(run["bytes"]) > top:
            break
        n += 1
    return n if n >= FANOUT else 0


def _merge_tiers(spark: SparkSession, root: str, state: dict, names: list[str]) -> None:
    """Merge the newest runs of a tier into one, and publish. The merged run's
    number is above theirs and below the next unit's, so run order stays
    version order; a crash before the new pointer leaves the old runs live."""
    merged = False
    for name in names:
        log = state["log"][name]
        while n := _due(log):
            rows = _latest(_runs(spark, root, name, state, log[-n:]).drop(BUCKET), state["keys"][name])
            log[-n:] = [_write_run(rows, root, name, state, log[-1]["version"])]
            merged = True
    if merged:
        _publish(spark, root, state)


# ---------------------------------------------------------------- reading

def _runs(spark: SparkSession, root: str, name: str, state: dict, log: list[dict] | None = None) -> DataFrame:
    """Live runs (or those of ``log``) as one partitioned dataset with the
    column ``run``. The state has the schema, so no footer is read for it."""
    schema = T.StructType.fromJson(json.loads(state["schemas"][name])).add(RUN, T.LongType())
    paths = [r["path"] for r in (state["log"][name] if log is None else log)]
    return spark.read.schema(schema).option("basePath", f"{root.rstrip('/')}/{name}").parquet(*paths)


def _latest(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of every key (``max_by``: a partial aggregate, so a key
    changed in many versions is reduced map-side)."""
    cols = [c for c in runs.columns if c not in keys and c != RUN]
    return (runs.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(RUN)).alias("_row"))
            .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in cols]))


def read_snapshot(spark: SparkSession, root: str, base: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """Whole tables as of the newest version: each from the newest unit that
    wrote it (``base`` gives paths for tables never published)."""
    state = newest_manifest(spark, root)
    latest = {**dict(base or {}), **(state["tables"] if state else {})}
    return {name: spark.read.parquet(path) for name, path in latest.items()}


def published_changes(spark: SparkSession, root: str) -> dict[str, list[tuple[int, str]]]:
    """Live runs under ``root`` since the last compaction: table ->
    [(newest version in it, path), ...]; empty before the first one."""
    state = newest_manifest(spark, root)
    return {name: [(r["version"], r["path"]) for r in log] for name, log in (state["log"] if state else {}).items() if log}


def merge_on_read(base: DataFrame, runs: DataFrame | None, key: str | list[str]) -> DataFrame:
    """Current rows = base rows whose key never changed, plus the latest row of
    every changed key. ``runs`` has the column ``run``, higher for newer rows."""
    if runs is None:
        return base
    keys = [key] if isinstance(key, str) else list(key)
    latest = _latest(runs.select(*base.columns, RUN), keys)
    return base.join(latest.select(*keys), keys, "left_anti").unionByName(latest.select(*base.columns))


def _base(spark: SparkSession, entry: dict) -> DataFrame:
    if entry.get("buckets"):
        return open_bucketed(spark, entry["path"], entry["by"], entry["buckets"])
    return spark.read.parquet(entry["path"])


def read_current(spark: SparkSession, base: Mapping[str, DataFrame], root: str,
                 keys: Mapping[str, str | list[str]]) -> dict[str, DataFrame]:
    """Tables of ``base`` (or the log's own bases) with every change published
    since then applied."""
    state = newest_manifest(spark, root)
    out = dict(base)
    if state is None:
        return out
    for name, entry in state["bases"].items():
        out[name] = _base(spark, entry).drop(BUCKET)
    for name, log in state["log"].items():
        if log:
            out[name] = merge_on_read(out[name], _runs(spark, root, name, state).drop(BUCKET), keys[name])
    return out


def start_log(tables: Mapping[str, DataFrame], root: str, keys: Mapping[str, str | list[str]],
              by: Mapping[str, str], buckets: int) -> None:
    """Write ``tables`` as bucketed bases below ``root`` (each by its column in
    ``by``) and publish them as version -1; nothing to do if a state is there."""
    spark = next(iter(tables.values())).sparkSession
    root = root.rstrip("/")
    if newest_manifest(spark, root) is not None:
        return
    state = _empty_state()
    for name, df in tables.items():
        path = f"{root}/{name}/base-{uuid.uuid4().hex}"
        save_by_bucket(df, path, by[name], buckets)
        state["bases"][name] = {"path": path, "by": by[name], "buckets": buckets, "bytes": _bytes_below(spark, path)}
        state["keys"][name] = [keys[name]] if isinstance(keys[name], str) else list(keys[name])
    _publish(spark, root, state)


def rows_for(spark: SparkSession, root: str, name: str, wanted: DataFrame, state: dict | None = None) -> DataFrame:
    """Current rows of a bucketed table whose bucket column is in ``wanted`` (a
    frame with that column). Only the buckets hit are read: their numbers, at
    most ``buckets`` of them, come to the driver and prune the scan. The base is
    joined bucket by bucket, so only ``wanted`` is shuffled, and what comes out
    is bounded by ``wanted``, not by the table."""
    state = state or newest_manifest(spark, root)
    entry, keys = state["bases"][name], state["keys"][name]
    by, buckets = entry["by"], entry["buckets"]
    asked = wanted.select(by).where(F.col(by).isNotNull()).distinct().withColumn(BUCKET, bucket_of(by, buckets))
    hit = [r[0] for r in asked.select(BUCKET).distinct().collect()]
    asked = asked.select(by)
    base = _base(spark, entry).where(F.col(BUCKET).isin(hit)).join(asked, by, "left_semi").drop(BUCKET)
    if not state["log"].get(name):
        return base
    runs = _runs(spark, root, name, state).where(F.col(BUCKET).isin(hit)).join(asked, by, "left_semi")
    return merge_on_read(base, runs.drop(BUCKET), keys)


def compact(spark: SparkSession, base: Mapping[str, DataFrame], root: str, keys: Mapping[str, str | list[str]],
            out_root: str) -> dict[str, str]:
    """Write the current tables (base + all runs) as new bases under
    ``out_root``, bucketed as before, and publish a state that starts from them
    with an empty log. Run it between units."""
    state = newest_manifest(spark, root)
    if state is None:
        return {}
    cur = read_current(spark, base, root, keys)
    paths = {}
    for name, log in state["log"].items():
        if log:
            path = paths[name] = f"{out_root.rstrip('/')}/{name}"
            old = state["bases"].get(name) or {}
            if old.get("buckets"):
                save_by_bucket(cur[name], path, old["by"], old["buckets"])
            else:
                cur[name].write.mode("errorifexists").parquet(path)
            state["bases"][name] = {**old, "path": path, "bytes": _bytes_below(spark, path)}
            state["tables"][name] = path
    state["log"] = {}
    _publish(spark, root, state)
    return paths


def compact_if_large(spark: SparkSession, root: str, share: float = 0.5) -> dict[str, str]:
    """Fold the log into new bases when a table's runs have grown to ``share`` of
    its base in bytes: the cost of rewriting a base is spread over that many changes."""
    state = newest_manifest(spark, root)
    if state is None or not any(sum(r["bytes"] for r in log) > share * max(state["bases"][n]["bytes"], SMALL_RUN)
                                for n, log in state["log"].items() if n in state["bases"]):
        return {}
    return compact(spark, {}, root, state["keys"], f"{root.rstrip('/')}/bases/v={state['version']}-{uuid.uuid4().hex}")


# ---------------------------------------------------------------- archive

def write_archive(df: DataFrame, path: str, batch_id: str | int = 0, ts_col: str = "created_at") -> None:
    """Put the rows of archive run ``batch_id`` into the archive, partitioned
    by batch and by month of ``ts_col`` (archive_month = yyyy-MM). A run replaces
    what an earlier attempt of the same batch wrote, so a rerun doubles nothing."""
    (df.withColumn("archive_month", F.date_format(ts_col, "yyyy-MM"))
     .write.mode("overwrite").partitionBy("archive_month").parquet(f"{path.rstrip('/')}/batch_id={batch_id}"))


def read_archive(spark: SparkSession, path: str, first_month: str | None = None, last_month: str | None = None) -> DataFrame:
    """The archived rows of all batches; ``first_month`` and ``last_month``
    (yyyy-MM, inclusive) prune whole month folders before any file is opened."""
    rows = spark.read.option("basePath", path).parquet(path)
    month = F.col("archive_month").cast("string")
    if first_month:
        rows = rows.where(month >= first_month)
    if last_month:
        rows = rows.where(month <= last_month)
    return rows.drop("archive_month", "batch_id")
