"""Payment callbacks (R1, R2): parse nested JSON, route dead letters, apply to
transactions, payments and orders.

R1 is a per-row projection, so it runs on a stream as well as on a batch.
R2 runs inside ``foreachBatch``: each micro-batch is de-duplicated by
checkout id (latest arrival wins), applied to the current rows it names with
the T2 patch, and published as one new version per batch id (S3). The tables
are the bucketed bases of a change log: a batch reads the buckets its keys fall
into and nothing of the base is shuffled. A replayed batch id finds its version
already published and is skipped, so applying a batch twice equals applying it
once. Callbacks with a field that the tables' rules forbid are dead letters.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storefront.functions.scalar import append_note, item_value, ts_lit
from storefront.operators.changes import first_reason, patch
from storefront.operators.quality import MAX_LENGTH
from storefront.session import checkpoint_root
from storefront.sources.sinks import compact_if_large, newest_manifest, rows_for, start_log, write_snapshot

Tables = Mapping[str, DataFrame]

_ITEM = T.StructType([T.StructField("Name", T.StringType()), T.StructField("Value", T.StringType())])
CALLBACK_SCHEMA = T.StructType([T.StructField("Body", T.StructType([T.StructField("stkCallback", T.StructType([
    T.StructField("MerchantRequestID", T.StringType()),
    T.StructField("CheckoutRequestID", T.StringType()),
    T.StructField("ResultCode", T.StringType()),
    T.StructField("ResultDesc", T.StringType()),
    T.StructField("CallbackMetadata", T.StructType([T.StructField("Item", T.ArrayType(_ITEM))])),
]))]))])


class Parsed(NamedTuple):
    good: DataFrame
    dead: DataFrame


def parse_callbacks(raw: DataFrame, text: str = "value", seq: str | None = None) -> Parsed:
    """JSON text -> one row per callback with the four metadata items.

    ``ResultCode`` is read as text, so 0 and "0" both mean success (D10).
    Unparseable text or a callback without a checkout id goes to ``dead``.
    The callback's phone and amount are kept as columns (the reference reads
    them but stores neither).
    """
    return _sorted_out(_callback_rows(raw, text, seq), seq)


def _callback_rows(raw: DataFrame, text: str = "value", seq: str | None = None) -> DataFrame:
    """One row per text, the good and the dead, with the text as ``raw``. The
    text is parsed once in this projection; a filter above it would be pushed
    below and parse again for every column that it names."""
    c = F.col("_cb")
    p = (raw.withColumn("_cb", F.from_json(F.col(text), CALLBACK_SCHEMA)["Body"]["stkCallback"])
         .withColumn("_items", c["CallbackMetadata"]["Item"]))
    code = F.trim(c["ResultCode"])
    return p.select(
        *([F.col(seq).alias("seq")] if seq else []),
        F.col(text).alias("raw"),
        c["CheckoutRequestID"].alias("checkout_request_id"), c["MerchantRequestID"].alias("merchant_request_id"),
        code.alias("result_code"), c["ResultDesc"].alias("result_desc"),
        (code == "0").alias("success"),
        item_value(F.col("_items"), "Amount").cast("decimal(12,2)").alias("callback_amount"),
        item_value(F.col("_items"), "MpesaReceiptNumber").alias("mpesa_receipt_number"),
        F.expr("try_cast(get(filter(_items, x -> x.Name = 'TransactionDate'), 0).Value AS BIGINT)").alias(
            "transaction_date"),
        item_value(F.col("_items"), "PhoneNumber").alias("callback_phone"))


def _sorted_out(rows: DataFrame, seq: str | None) -> Parsed:
    bad = F.col("checkout_request_id").isNull() | F.col("result_code").isNull()
    return Parsed(rows.where(~bad).drop("raw"), rows.where(bad).select(*([F.col("seq")] if seq else []), "raw"))


def route_unknown(parsed: DataFrame, txns: DataFrame) -> Parsed:
    """Callbacks whose checkout id matches no transaction are dead letters
    (stream-static anti join when ``parsed`` is a stream)."""
    ids = txns.select("checkout_request_id")
    return Parsed(parsed.join(ids, "checkout_request_id", "left_semi"),
                  parsed.join(ids, "checkout_request_id", "left_anti"))


def route_invalid(parsed: DataFrame) -> Parsed:
    """Callbacks that would write a value the tables forbid (a result code
    or receipt that is too long) are dead letters with the broken rules as
    ``reason``; a callback changes all its tables or none."""
    marked = parsed.withColumn("mpesa_code", F.col("mpesa_receipt_number"))
    receipt = F.col("success") & F.col("mpesa_receipt_number").isNotNull()
    rules = [(f"{column}_max_length_{size}", F.length(column) <= size) for column, size in (
        ("result_code", MAX_LENGTH["mpesa_transactions"]["result_code"]),
        ("mpesa_receipt_number", MAX_LENGTH["mpesa_transactions"]["mpesa_receipt_number"]),
        ("mpesa_code", MAX_LENGTH["payments"]["mpesa_code"]))]
    rules = [(name, ok if name.startswith("result") else ~receipt | ok) for name, ok in rules]
    marked = marked.withColumn("reason", first_reason(rules)).drop("mpesa_code")
    return Parsed(marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull()))


def latest_per_checkout(parsed: DataFrame, seq: str = "seq") -> DataFrame:
    """Duplicates by checkout id are applied once: the latest arrival wins.
    ``max_by`` is a partial aggregate, so a much-repeated id is reduced on the
    map side."""
    others = [c for c in parsed.columns if c != "checkout_request_id"]
    return (parsed.groupBy("checkout_request_id").agg(F.max_by(F.struct(*others), F.col(seq)).alias("_l"))
            .select("checkout_request_id", *[F.col(f"_l.{c}").alias(c) for c in others]))


def apply_callbacks(t: Tables, parsed: DataFrame, as_of, seq: str = "seq",
                    changed_only: bool = False) -> dict[str, DataFrame]:
    """R2 on one batch: success -> transaction completed (receipt, date, code,
    text), the order's mpesa payment confirmed (code = receipt, confirmed_at =
    as_of), order processing; failure -> transaction failed (code, text),
    order failed with ' | Payment failed: <text>' appended to its notes.
    With ``changed_only`` only the changed rows of each table are returned
    (full rows), for publication as a change set."""
    cb = latest_per_checkout(parsed, seq).join(
        t["mpesa_transactions"].select("checkout_request_id", "order_id"), "checkout_request_id")
    tx_changes = cb.select(
        "checkout_request_id", F.col(seq).alias("seq"),
        F.when(F.col("success"), "completed").otherwise("failed").alias("status"),
        "mpesa_receipt_number", "transaction_date", "result_code", "result_desc",
        F.when(F.col("success"), F.array(*[F.lit(x) for x in ("status", "mpesa_receipt_number", "transaction_date",
                                                              "result_code", "result_desc")]))
        .otherwise(F.array(*[F.lit(x) for x in ("status", "result_code", "result_desc")])).alias("changed"))
    tx_patch = patch(t["mpesa_transactions"], tx_changes, "checkout_request_id", "present", as_of=as_of)
    txns = tx_patch.affected if changed_only else tx_patch.table

    ok = cb.where("success")
    pay_keys = t["payments"].where(F.col("method") == "mpesa").select("payment_id", "order_id")
    pay_changes = ok.join(pay_keys, "order_id").select(
        "payment_id", F.col(seq).alias("seq"), F.lit(True).alias("is_confirmed"),
        F.col("mpesa_receipt_number").alias("mpesa_code"), ts_lit(as_of).alias("confirmed_at"),
        F.array(F.lit("is_confirmed"), F.lit("mpesa_code"), F.lit("confirmed_at")).alias("changed"))
    pay_patch = patch(t["payments"], pay_changes, "payment_id", "present")
    payments = pay_patch.affected if changed_only else pay_patch.table

    # Per order the latest callback decides; a failure appends its note.
    per_order = cb.groupBy("order_id").agg(
        F.max_by(F.struct(F.col("success").alias("_ok"), F.col("result_desc").alias("_desc")), F.col(seq)).alias("_l"))
    o = t["orders"].join(per_order.select("order_id", "_l._ok", "_l._desc"), "order_id", "left")
    hit = F.col("_ok").isNotNull()
    o = (o.withColumn("status", F.when(hit, F.when(F.col("_ok"), "processing").otherwise("failed"))
                      .otherwise(F.col("status")))
         .withColumn("notes", F.when(hit & ~F.col("_ok"), append_note(
             "notes", F.concat(F.lit("Payment failed: "), F.coalesce(F.col("_desc"), F.lit("")))))
                     .otherwise(F.col("notes"))))
    if "updated_at" in o.columns:
        o = o.withColumn("updated_at", F.when(hit, ts_lit(as_of)).otherwise(F.col("updated_at")))
    if changed_only:
        o = o.where(hit)
    orders = o.drop("_ok", "_desc").select(*t["orders"].columns)
    return {"mpesa_transactions": txns.select(*t["mpesa_transactions"].columns),
            "payments": payments.select(*t["payments"].columns), "orders": orders}


def callback_json(txns: DataFrame, success: F.Column, code: F.Column, desc: F.Column) -> DataFrame:
    """Callback documents for transactions, as the payment service sends them
    (used to feed tests and the stream examples). Success callbacks carry the
    Amount, MpesaReceiptNumber, TransactionDate and PhoneNumber items."""
    items = F.when(success, F.struct(F.array(
        F.struct(F.lit("Amount").alias("Name"), F.col("amount").cast("string").alias("Value")),
        F.struct(F.lit("MpesaReceiptNumber").alias("Name"),
                 F.concat(F.lit("Q"), F.col("transaction_id").cast("string")).alias("Value")),
        F.struct(F.lit("TransactionDate").alias("Name"),
                 F.date_format("created_at", "yyyyMMddHHmmss").alias("Value")),
        F.struct(F.lit("PhoneNumber").alias("Name"), F.col("phone_number").alias("Value"))).alias("Item")))
    body = F.struct(F.struct(
        F.concat(F.lit("mr_"), F.col("transaction_id").cast("string")).alias("MerchantRequestID"),
        F.col("checkout_request_id").alias("CheckoutRequestID"), code.alias("ResultCode"), desc.alias("ResultDesc"),
        items.alias("CallbackMetadata")).alias("stkCallback")).alias("Body")
    return txns.select(F.col("transaction_id").alias("seq"), F.to_json(F.struct(body)).alias("value"))


# Keys of the tables a callback batch changes, and the columns their bases are bucketed by.
CALLBACK_KEYS = {"mpesa_transactions": "checkout_request_id", "payments": "payment_id", "orders": "order_id"}
CALLBACK_BUCKETS = {"mpesa_transactions": "checkout_request_id", "payments": "order_id", "orders": "order_id"}


def rows_of_callbacks(spark: SparkSession, root: str, parsed: DataFrame, state: dict | None = None) -> dict[str, DataFrame]:
    """The current rows that a batch of callbacks can change: its transactions
    by checkout id (written once: the other two are looked up by them), and the
    payments and orders of those transactions."""
    checkpoint_root(spark)
    txns = rows_for(spark, root, "mpesa_transactions", parsed, state).checkpoint(eager=True)
    return {"mpesa_transactions": txns, "payments": rows_for(spark, root, "payments", txns, state),
            "orders": rows_for(spark, root, "orders", txns, state)}


def ingest_callbacks(spark: SparkSession, source_dir: str, tables: Tables, state_root: str, as_of,
                     checkpoint: str, max_files_per_trigger: int | None = None, buckets: int = 16) -> str:
    """R1 + R2 as a stream: JSON lines in ``source_dir`` -> parse -> per
    micro-batch apply to the current rows -> publish the changed rows as one
    change set per batch id under ``state_root`` (ids already published are
    skipped). The first run writes the three tables as bucketed bases of a
    change log there; on a cluster choose ``buckets`` so that a bucket's file is
    a few hundred MB. A batch is parsed once and kept until it is published. It reads the buckets of its keys and the live runs,
    and writes what it changed; the log is folded into new bases when it has
    grown to half of them. A batch's dead letters (malformed, unknown checkout
    id, forbidden values) are overwritten under
    ``state_root/dead_letters/batch_id=<n>``, so a replay writes them once.
    Returns state_root."""
    reader = spark.readStream.schema("seq long, value string")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.json(source_dir)
    root = state_root.rstrip("/")
    start_log({k: tables[k] for k in CALLBACK_KEYS}, root, CALLBACK_KEYS, CALLBACK_BUCKETS, buckets)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        state = newest_manifest(spark, root)
        if batch_id <= state["version"]:
            return  # replay of a published batch
        rows = _callback_rows(batch, seq="seq").persist()  # every table's changes come from these rows
        try:
            parsed = _sorted_out(rows, "seq")
            sound = route_invalid(parsed.good)
            current = rows_of_callbacks(spark, root, sound.good, state)
            known = route_unknown(sound.good, current["mpesa_transactions"])
            none = F.lit(None).cast("string")
            dead = (parsed.dead.select("seq", "raw", F.lit("malformed").alias("reason"))
                    .unionByName(sound.dead.select("seq", none.alias("raw"), "reason"))
                    .unionByName(known.dead.select("seq", none.alias("raw"), F.lit("unknown checkout id").alias("reason"))))
            dead.write.mode("overwrite").parquet(f"{root}/dead_letters/batch_id={batch_id}")
            write_snapshot(apply_callbacks(current, known.good, as_of, changed_only=True), root, batch_id, keys=CALLBACK_KEYS)
        finally:
            rows.unpersist()
        compact_if_large(spark, root)

    q = (raw.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return root
