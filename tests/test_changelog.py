"""The change log (S3), its bucketed bases (R2, R6), the archive (S4) and checked loading."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from storefront.sources import sinks
from storefront.sources.layout import BUCKET, _catalog_name
from storefront.sources.schemas import load_checked
from storefront.streaming import callbacks as CB

AS_OF = "2024-06-01 00:00:00"
KEY = {"t": "k"}


def _plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def _rows(df):
    return {r.k: r.v for r in df.collect()}


def _started(spark, root, n=50, buckets=4):
    base = spark.range(n).select(F.col("id").alias("k"), F.lit(-1).cast("long").alias("v"))
    sinks.start_log({"t": base}, root, KEY, KEY, buckets)
    return base


def test_two_hundred_versions_read_as_few_files_as_twenty(spark, tmp_path):
    root = str(tmp_path / "log")
    base = _started(spark, root)
    seen = {}
    for v in range(200):
        sinks.write_snapshot({"t": spark.range(1).select(F.lit(v % 50).cast("long").alias("k"), F.lit(v).cast("long").alias("v"))}, root, v, keys=KEY)
        if v in (19, 199):
            cur = sinks.read_current(spark, {"t": base}, root, KEY)["t"]
            seen[v] = (_plan(cur).count("FileScan"), len(_plan(cur).splitlines()))
            assert len(sinks.published_changes(spark, root)["t"]) < sinks.FANOUT
            assert len(json.dumps(sinks.newest_manifest(spark, root))) < 4000
    assert seen[19] == seen[199]
    cur = sinks.read_current(spark, {"t": base}, root, KEY)["t"]
    assert _rows(cur) == {k: 150 + k for k in range(50)}
    assert sinks.is_published(spark, root, 199) and not sinks.is_published(spark, root, 200)


@pytest.mark.parametrize("grow", [1.0, 0.0])
def test_live_runs_grow_with_the_logarithm(grow):
    """``grow``: merged runs keep all bytes (new keys) or stay small (the same keys)."""
    log, most = [], 0
    for i in range(20_000):
        log.append({"bytes": sinks.SMALL_RUN // 2})
        while n := sinks._due(log):
            log[-n:] = [{"bytes": int(max(grow * sum(r["bytes"] for r in log[-n:]), sinks.SMALL_RUN // 2))}]
        most = max(most, len(log))
    assert most <= (sinks.FANOUT - 1) * 6


def test_a_unit_shows_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "log")
    base = _started(spark, root)
    change = spark.createDataFrame([(1, 7)], "k long, v long")
    with monkeypatch.context() as m:
        m.setattr(sinks, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            sinks.write_snapshot({"t": change}, root, 0, keys=KEY)
    assert _rows(sinks.read_current(spark, {"t": base}, root, KEY)["t"])[1] == -1
    sinks.write_snapshot({"t": change}, root, 0, keys=KEY)
    assert _rows(sinks.read_current(spark, {"t": base}, root, KEY)["t"])[1] == 7
    with pytest.raises(ValueError):
        sinks.write_snapshot({"t": change}, root, 0, keys=KEY)


def _above(plan: str, leaf: str) -> list[str]:
    """The operators from the line that has ``leaf`` up to the nearest join."""
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if leaf in x)
    depth, out = len(re.match(r"[ :+\-]*", lines[at]).group()), []
    for x in reversed(lines[:at]):
        d = len(re.match(r"[ :+\-]*", x).group())
        if d < depth:
            out.append(x)
            depth = d
            if "Join" in x:
                return out
    return out


def test_a_lookup_reads_its_buckets_and_shuffles_no_base(spark, tmp_path):
    root = str(tmp_path / "log")
    _started(spark, root, n=1000, buckets=16)
    sinks.write_snapshot({"t": spark.createDataFrame([(3, 33), (5000, 50)], "k long, v long")}, root, 0, keys=KEY)
    wanted = spark.createDataFrame([(3,), (4,), (4,), (None,), (5000,), (77777,)], "k long")
    conf = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = sinks.rows_for(spark, root, "t", wanted)
        plan = _plan(found)
        name = _catalog_name(sinks.newest_manifest(spark, root)["bases"]["t"]["path"])
        assert not any("Exchange" in x for x in _above(plan, name))
        asked = re.search(r"PartitionFilters: \[.*?" + BUCKET + r"#\d+ IN \(([\d,]+)\)", plan)
        assert asked and len(asked.group(1).split(",")) <= 4
        assert _rows(found) == {3: 33, 4: -1, 5000: 50}
    finally:
        for c, v in conf.items():
            spark.conf.set(c, v)
    # Another session's catalog does not have the base yet.
    spark.sql(f"DROP TABLE {name}")
    assert _rows(sinks.rows_for(spark, root, "t", wanted)) == {3: 33, 4: -1, 5000: 50}


def test_a_large_log_is_folded_into_bucketed_bases(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "log")
    base = _started(spark, root)
    monkeypatch.setattr(sinks, "SMALL_RUN", 1)
    for v in range(3):
        sinks.write_snapshot({"t": spark.range(60).select(F.col("id").alias("k"), F.lit(v).cast("long").alias("v"))}, root, v, keys=KEY)
    assert set(sinks.compact_if_large(spark, root)) == {"t"}
    assert sinks.published_changes(spark, root) == {} and sinks.compact_if_large(spark, root) == {}
    assert _rows(sinks.read_current(spark, {"t": base}, root, KEY)["t"]) == {k: 2 for k in range(60)}
    assert _rows(sinks.rows_for(spark, root, "t", spark.createDataFrame([(59,)], "k long"))) == {59: 2}


def _body(checkout, code=0, receipt="QX1"):
    items = [{"Name": "Amount", "Value": 1}, {"Name": "MpesaReceiptNumber", "Value": receipt}]
    return json.dumps({"Body": {"stkCallback": {"MerchantRequestID": "m", "CheckoutRequestID": checkout, "ResultCode": code, "ResultDesc": "d",
                                                **({"CallbackMetadata": {"Item": items}} if code == 0 else {})}}})


def test_a_callback_with_a_forbidden_value_is_a_dead_letter(seed, spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "state")
    ids = [r.checkout_request_id for r in seed["mpesa_transactions"].orderBy("transaction_id").collect()]
    spark.createDataFrame([(1, _body(ids[0], receipt="R" * 30)), (2, _body(ids[1], code="9" * 20)), (3, "{"), (4, _body("nobody"))],
                          "seq long, value string").coalesce(1).write.json(src)
    CB.ingest_callbacks(spark, src, seed, root, AS_OF, str(tmp_path / "ckpt"), buckets=4)
    dead = {r.seq: r.reason for r in spark.read.parquet(f"{root}/dead_letters").collect()}
    assert dead == {1: "mpesa_code_max_length_20", 2: "result_code_max_length_10", 3: "malformed", 4: "unknown checkout id"}
    cur = sinks.read_current(spark, {k: seed[k] for k in CB.CALLBACK_KEYS}, root, CB.CALLBACK_KEYS)
    for name in CB.CALLBACK_KEYS:
        assert sorted(map(str, cur[name].select(*seed[name].columns).collect())) == sorted(map(str, seed[name].collect()))


def test_a_batch_of_callbacks_is_parsed_once(seed, spark, tmp_path, monkeypatch):
    """The changes of all tables come from the kept rows, none from the texts again."""
    src, root = str(tmp_path / "in"), str(tmp_path / "state")
    ids = [r.checkout_request_id for r in seed["mpesa_transactions"].orderBy("transaction_id").collect()]
    spark.createDataFrame([(1, _body(ids[0])), (2, "{"), (3, _body("nobody"))], "seq long, value string").coalesce(1).write.json(src)
    seen = {}
    write = CB.write_snapshot

    def spied(changed, *args, **kw):
        for name, df in changed.items():
            leaves = df._jdf.queryExecution().withCachedData().collectLeaves()
            seen[name] = [(leaves.apply(i).nodeName(), leaves.apply(i).output().mkString(" ")) for i in range(leaves.size())]
        return write(changed, *args, **kw)

    monkeypatch.setattr(CB, "write_snapshot", spied)
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    CB.ingest_callbacks(spark, src, seed, root, AS_OF, str(tmp_path / "ckpt"), buckets=4)
    assert seen.keys() == CB.CALLBACK_KEYS.keys()
    for leaves in seen.values():
        assert any(name.startswith("InMemoryRelation") for name, _ in leaves)
        assert not any("value#" in output for _, output in leaves)
    assert {r.seq: r.reason for r in spark.read.parquet(f"{root}/dead_letters").collect()} == {2: "malformed", 3: "unknown checkout id"}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= kept


def test_the_archive_prunes_by_month_and_doubles_nothing(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = spark.sql("SELECT id, TIMESTAMP_NTZ'2024-01-15 00:00:00' + make_interval(0, CAST(id AS INT)) AS created_at FROM range(6)")
    for batch in (0, 1, 0, 1):
        sinks.write_archive(rows.where(F.col("id") % 2 == batch), path, batch)
    assert sinks.read_archive(spark, path).count() == 6
    some = sinks.read_archive(spark, path, "2024-02", "2024-04")
    assert sorted(r.id for r in some.collect()) == [1, 2, 3]
    assert re.search(r"PartitionFilters: \[[^\]]*archive_month", _plan(some))
    # A rerun that has fewer rows leaves none of the first attempt's.
    sinks.write_archive(rows.where("id = 0"), path, 0)
    assert sinks.read_archive(spark, path).count() == 4


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_rows_that_do_not_fit_are_quarantined(spark, tmp_path, fmt):
    path = str(tmp_path / "offers")
    if fmt == "csv":
        lines = ["1,2", "x,3", "4", "5,", "6,7,8", "9,10"]
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
        good, bad = {(1, 2), (9, 10)}, {"x,3", "4", '{"product_id":5}', "6,7,8"}
    elif fmt == "json":
        lines = ['{"product_id": 1, "offer_id": 2}', '{"product_id": "x", "offer_id": 3}', "{broken", '{"offer_id": 4}', '{"product_id": 9, "offer_id": 10, "more": 1}']
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
        good, bad = {(1, 2), (9, 10)}, {lines[1], lines[2], '{"offer_id":4}'}
    else:
        spark.createDataFrame([(1, 2), (None, 3), (9, 10)], "product_id long, offer_id long").write.parquet(path)
        good, bad, lines = {(1, 2), (9, 10)}, {'{"offer_id":3}'}, [None] * 3
    loaded = load_checked(spark, path, "product_offers", fmt)
    assert {tuple(r) for r in loaded.rows.collect()} == good
    assert {r.raw for r in loaded.quarantined.collect()} == bad
    assert loaded.rows.count() + loaded.quarantined.count() == len(lines)
    # Fewer columns give the same rows.
    assert loaded.rows.select("offer_id").count() == len(good) and loaded.quarantined.select("raw").count() == len(bad)
