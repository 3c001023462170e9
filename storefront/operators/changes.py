"""Table changes in bulk (T1-T16) on immutable DataFrames.

Parquet tables have no MERGE, so every change is a join that returns the new
table together with the affected and the rejected rows (what RETURNING gives
the reference). Change sets are DataFrames of any size; nothing is collected.

Conventions
* ``seq``: arrival order of changes; the last change wins where several touch
  one key (reduced with ``max_by``, a partial aggregate, so a hot key is merged
  on the map side).
* ``as_of``: the clock for every timestamp the change writes (D1).
* ``updated_at`` is written only when the table has the column (D12).
* Writes keep the shop's constraints (CHECK, NOT NULL, lengths, enums, foreign
  keys, unique keys): a row that would break one is rejected with the reason,
  and the table keeps its old row. Foreign keys are checked where the tables
  are given (``parents``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storefront.functions.scalar import (
    ago, amount_matches, append_note, selling_price, ts_lit, valid_phone)
from storefront.operators.quality import CHECKS, FOREIGN_KEYS, ROW_RULES, UNIQUE, table_rules
from storefront.session import checkpoint_root
from storefront.sources.schemas import PRIMARY_KEYS, SCHEMAS

Tables = Mapping[str, DataFrame]


class Change(NamedTuple):
    table: DataFrame
    affected: DataFrame
    rejected: DataFrame


def _touch(df: DataFrame, as_of, cond: Column | None = None) -> DataFrame:
    """Set updated_at = as_of (where ``cond``), only if the table has the column."""
    if as_of is None or "updated_at" not in df.columns:
        return df
    v = ts_lit(as_of)
    return df.withColumn("updated_at", v if cond is None else F.when(cond, v).otherwise(F.col("updated_at")))


def _flag(keys: DataFrame, on: Sequence[str], name: str = "_hit") -> DataFrame:
    return keys.select(*on).dropDuplicates().withColumn(name, F.lit(True))


# ---------------------------------------------------------------- T1 inserts

def assign_keys(rows: DataFrame, key: str, start: Column) -> DataFrame:
    """New keys ``start + 1, start + 2, ...`` without a global window.

    The rows are checkpointed (reliable, in spark.checkpoint.dir) so their
    partitioning is fixed; each row's position inside its partition comes
    from ``monotonically_increasing_id`` (partition id in the high bits), the
    per-partition counts (one row per partition) give the offsets.
    """
    checkpoint_root(rows.sparkSession)
    stable = rows.checkpoint(eager=True)
    m = stable.withColumn("_mid", F.monotonically_increasing_id())
    m = m.withColumn("_pid", F.shiftright("_mid", 33)).withColumn(
        "_idx", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = m.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_off", F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["_off"])
    out = m.join(offsets.select("_pid", "_off"), "_pid")  # one row per partition
    return out.withColumn(key, (start + F.col("_off") + F.col("_idx") + 1).cast("long")).drop(
        "_mid", "_pid", "_idx", "_off")


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The broken rules' names, comma-joined; NULL when none is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(r, F.lit(True)), F.lit(n)) for n, r in rules])) \
        if rules else F.array().cast("array<string>")
    return F.when(F.size(broken) > 0, F.array_join(broken, ","))


def _missing_parents(rows: DataFrame, name: str, parents: Tables, columns: Sequence[str]) -> DataFrame:
    """Add to ``reason`` (where still NULL) 'missing <parent>' for foreign keys
    without a parent row. Parent keys are primary keys, so no row multiplies."""
    for child, col, parent, pcol, _ in FOREIGN_KEYS:
        if child != name or col not in columns or parent not in parents:
            continue
        keys = parents[parent].select(F.col(pcol).alias("_pk"), F.lit(True).alias("_there"))
        rows = rows.join(keys, F.col(col) == F.col("_pk"), "left").withColumn("reason", F.coalesce(
            "reason", F.when(F.col(col).isNotNull() & F.col("_there").isNull(), F.lit(f"missing {parent}")))).drop("_pk", "_there")
    return rows


def insert_rows(base: DataFrame, rows: DataFrame, name: str, defaults: Mapping[str, object] | None = None,
                as_of=None, seq: str | None = "seq", parents: Tables | None = None) -> Change:
    """Insert with defaults and checks; new keys after the current maximum.

    Rejected (with reasons): broken rules (Q1), a foreign key without its row
    in ``parents``, a unique key already taken (in the table, or earlier in the
    same batch by ``seq``).
    """
    (key,) = PRIMARY_KEYS[name]
    r = rows
    for c, v in (defaults or {}).items():
        val = ts_lit(as_of) if v == "as_of" else F.lit(v)
        r = r.withColumn(c, F.coalesce(F.col(c), val) if c in r.columns else val)
    for f in SCHEMAS[name].fields:
        if f.name not in r.columns:
            r = r.withColumn(f.name, F.lit(None).cast(f.dataType))
    if seq is None or seq not in r.columns:
        # Arrival order is the row's position; written once so a recomputed
        # task cannot renumber the rows between the branches that use it.
        checkpoint_root(r.sparkSession)
        r = r.withColumn("seq", F.monotonically_increasing_id()).checkpoint(eager=True)
        seq = "seq"
    columns = r.columns
    r = r.withColumn("reason", first_reason([x for x in table_rules(name, columns) if x[0] != f"{key}_not_null"]))
    r = _missing_parents(r, name, parents or {}, columns)
    for cols in map(list, UNIQUE.get(name, ())):
        # Per key of the rows still good: its earliest row (a partial aggregate,
        # so a key repeated by a third of the batch shrinks on the map side),
        # and whether the table has it (semi join, no de-duplicated table).
        first = r.where(F.col("reason").isNull()).groupBy(*cols).agg(F.min(seq).alias("_first"))
        taken = first.join(base.select(*cols), cols, "left_semi").select(*cols, F.lit(True).alias("_taken"))
        marks = first.join(taken, cols, "left")
        r = r.join(marks, cols, "left").withColumn("reason", F.coalesce(
            "reason", F.when(F.col("_taken"), "duplicate " + ",".join(cols)),
            F.when(F.col(seq) != F.col("_first"), "duplicate " + ",".join(cols) + " in batch"))).drop("_first", "_taken")
    r = r.select(*columns, "reason")
    start = F.coalesce(base.select(F.max(key)).scalar(), F.lit(0))
    good = r.where(F.col("reason").isNull()).drop("reason")
    new = assign_keys(good.orderBy(seq), key, start).select(*base.columns)
    return Change(base.unionByName(new), new, r.where(F.col("reason").isNotNull()))


# ---------------------------------------------------------------- T2 patches

def _truthy(c: Column, dtype: str) -> Column:
    if dtype == "boolean":
        return F.coalesce(c, F.lit(False))
    if dtype == "string":
        return c.isNotNull() & (c != "")
    if dtype.startswith(("int", "bigint", "decimal", "double", "float", "smallint", "tinyint")):
        return c.isNotNull() & (c != 0)
    return c.isNotNull()


def _rule_columns(name: str) -> dict[str, set[str]]:
    """Columns each rule of a table reads."""
    columns = [f.name for f in SCHEMAS[name].fields]
    texts = dict(CHECKS.get(name, ()))
    return {rule: ({c for c in columns if re.search(rf"\b{c}\b", texts[rule])} if rule in texts
                   else {c for c in columns if rule.startswith(f"{c}_")})
            for rule, _ in table_rules(name, columns)}


def _fold_rules(keys: list[str], seen: list[str], rules: dict):
    """Decide changes one after the other: rows come sorted by key and seq; the
    state is the current key and the row's columns that the rules read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row = None, {}
        for batch in batches:
            names = batch.schema.names
            get = {c: batch.column(names.index(c)).to_pylist()
                   for c in {*keys, "_sets", "_known", *(f"_now_{c}" for c in seen), *(c for c in seen if c in names)}}
            reasons = []
            for i in range(batch.num_rows):
                now = tuple(get[c][i] for c in keys)
                if now != key:
                    key, row = now, {c: get[f"_now_{c}"][i] for c in seen}
                after = {**row, **{c: get[c][i] for c in get["_sets"][i]}}
                broken = [name for name, (_, holds) in rules.items() if not holds(after)] if get["_known"][i] else []
                if not broken:
                    row = after
                reasons.append(",".join(broken) or None)
            kept = [n for n in names if not n.startswith(("_now_", "_sets", "_known")) and n != "reason"]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in kept), pa.array(reasons, pa.string())],
                                             names=[*kept, "reason"])
    return run


def _decided_in_order(base: DataFrame, marked: DataFrame, keys: list[str], seq: str, cols: list[str], rules: dict, is_set) -> DataFrame:
    """``marked`` with the changes refused that break a rule over several
    columns at their turn. Only changes that set one of those columns take
    part, sorted by key and seq inside their partition and folded in one pass
    (a key's changes meet in one task; memory is one row)."""
    seen = sorted({c for columns, _ in rules.values() for c in columns})
    sets = F.array_compact(F.array(*[F.when(is_set(c), F.lit(c)) for c in seen if c in cols]))
    marked = marked.withColumn("_sets", sets)
    part = F.col("reason").isNull() & (F.size("_sets") > 0)
    now = base.select(*keys, F.lit(True).alias("_known"), *[F.col(c).alias(f"_now_{c}") for c in seen])
    rows = marked.where(part).join(now, keys, "left").repartition(*keys).sortWithinPartitions(*keys, seq)
    rows = rows.withColumn("_known", F.coalesce("_known", F.lit(False)))
    rest = marked.where(~part).drop("_sets")
    schema = T.StructType([f for f in rows.schema if not f.name.startswith(("_now_", "_sets", "_known")) and f.name != "reason"]
                          + [T.StructField("reason", T.StringType())])
    return rest.unionByName(rows.mapInArrow(_fold_rules(keys, seen, rules), schema))


def patch(base: DataFrame, changes: DataFrame, key: str | Sequence[str], mode: str = "present",
          seq: str = "seq", as_of=None, name: str | None = None, parents: Tables | None = None) -> Change:
    """Partial update of ``base`` from a change set.

    ``changes`` has the key, ``seq`` and any subset of base columns. In
    ``mode="present"`` a column is set when its name is in the row's
    ``changed`` array (so NULL can be written); in ``mode="truthy"`` when the
    value is truthy, like the reference's ``if (value)`` checks (D11): 0, false
    and '' are skipped. Per key and column the latest setting change wins.
    Unknown keys are rejected; ``updated_at`` becomes as_of on changed rows.

    With ``name`` the table's constraints hold: a change that sets a value its
    own rules forbid, or a foreign key without a row in ``parents``, is
    rejected by itself; rules over several columns are decided change by change
    in seq order, each against what the accepted ones before it left. (A row
    that broke a rule before keeps its old values unless its changes together
    mend it.) ``rejected`` then has a ``reason``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    dtypes = dict(changes.dtypes)
    cols = [c for c in changes.columns if c in base.columns and c not in keys]
    if mode not in ("present", "truthy"):
        raise ValueError("mode must be 'present' or 'truthy'")

    def is_set(c: str) -> Column:
        return F.array_contains(F.col("changed"), c) if mode == "present" else _truthy(F.col(c), dtypes[c])

    marked = changes.withColumn("reason", F.lit(None).cast("string"))
    if name is not None:
        # Rules a change decides alone: all their columns are set by it.
        reads = _rule_columns(name)
        alone = []
        for rule, ok in table_rules(name, base.columns):
            need = reads[rule]
            if need and need <= set(cols):
                given = F.lit(True)
                for c in sorted(need):
                    given = given & is_set(c)
                alone.append((rule, ~given | ok))
        marked = changes.withColumn("reason", first_reason(alone))
        for child, col, parent, pcol, _ in FOREIGN_KEYS:
            if child == name and col in cols and parent in (parents or {}):
                have = parents[parent].select(F.col(pcol).alias("_pk"), F.lit(True).alias("_there"))
                marked = marked.join(have, F.col(col) == F.col("_pk"), "left").withColumn("reason", F.coalesce(
                    "reason", F.when(is_set(col) & F.col(col).isNotNull() & F.col("_there").isNull(),
                                     F.lit(f"missing {parent}")))).drop("_pk", "_there")
        order_rules = {rule: x for rule, x in ROW_RULES.get(name, {}).items() if set(x[0]) & set(cols)}
        if order_rules:
            marked = _decided_in_order(base, marked, keys, seq, cols, order_rules, is_set)
    good = marked.where(F.col("reason").isNull())
    aggs = []
    for c in cols:
        s = F.when(is_set(c), F.col(seq))
        aggs += [F.max_by(F.col(c), s).alias(f"_v_{c}"), F.max(s).alias(f"_s_{c}")]
    per_key = good.groupBy(*keys).agg(*aggs, F.lit(True).alias("_hit"))
    joined = base.join(per_key, keys, "left")
    types = dict(base.dtypes)
    new = [F.when(F.col(f"_s_{c}").isNotNull(), F.col(f"_v_{c}")).otherwise(F.col(c)).cast(types[c]) if c in cols
           else F.col(c) for c in base.columns]
    out = joined.select(*[v.alias(c) for v, c in zip(new, base.columns)], "_hit",
                        F.struct(*[F.col(c) for c in base.columns]).alias("_old"))
    out = _touch(out, as_of, F.col("_hit").isNotNull())
    broken = None
    if name is not None:
        out = out.withColumn("_broken", F.when(F.col("_hit"), first_reason(table_rules(name, base.columns))))
        broken = out.where(F.col("_broken").isNotNull()).select(*keys, F.col("_broken"))
        back = F.col("_broken").isNotNull()
        out = out.select(*[F.when(back, F.col(f"_old.{c}")).otherwise(F.col(c)).alias(c) for c in base.columns],
                         F.when(~back, F.col("_hit")).alias("_hit"))
    table = out.select(*base.columns)
    affected = out.where(F.col("_hit").isNotNull()).select(*base.columns)
    if name is None:
        return Change(table, affected, changes.join(base.select(*keys), keys, "left_anti"))
    known = base.select(*keys, F.lit(True).alias("_known"))
    refused = (marked.join(known, keys, "left").join(broken, keys, "left")
               .withColumn("reason", F.when(F.col("_known").isNull(), "not found").otherwise(F.coalesce("reason", "_broken")))
               .where(F.col("reason").isNotNull()).select(*changes.columns, "reason"))
    return Change(table, affected, refused)


# ---------------------------------------------------------------- T3 - T5

def bulk_update(base: DataFrame, ids: DataFrame, values: Mapping[str, object], key: str, as_of=None,
                name: str | None = None) -> Change:
    """Set fixed values on every row whose key is in ``ids`` (role, order
    status, stock, price, ...). Unknown ids are rejected. With ``name`` the
    table's rules hold: a row that would break one keeps its old values and its
    id is rejected with the reason."""
    j = base.join(_flag(ids, [key]), key, "left").withColumn("_old", F.struct(*base.columns))
    hit = F.col("_hit").isNotNull()
    types = dict(base.dtypes)
    for c, v in values.items():
        val = v if isinstance(v, Column) else F.lit(v)
        j = j.withColumn(c, F.when(hit, val.cast(types[c])).otherwise(F.col(c)))
    j = _touch(j, as_of, hit)
    missing = ids.select(key).dropDuplicates().join(base.select(key), key, "left_anti")
    if name is None:
        return Change(j.select(*base.columns), j.where(hit).select(*base.columns), missing)
    j = j.withColumn("reason", F.when(hit, first_reason(table_rules(name, base.columns))))
    back = F.col("reason").isNotNull()
    refused = j.where(back).select(key, "reason").unionByName(missing.withColumn("reason", F.lit("not found")))
    j = j.select(*[F.when(back, F.col(f"_old.{c}")).otherwise(F.col(c)).alias(c) for c in base.columns],
                 (hit & ~back).alias("_done"))
    return Change(j.select(*base.columns), j.where("_done").select(*base.columns), refused)


def set_seller_status(t: Tables, actions: DataFrame, as_of=None) -> Change:
    """T4: seller approve / suspend sets the owning user's role to seller /
    guest (last action per seller wins). Unknown sellers and invalid actions
    are rejected."""
    valid = actions.where(F.col("action").isin("approve", "suspend"))
    last = valid.groupBy("seller_id").agg(F.max_by("action", "seq").alias("action"))
    owners = last.join(t["sellers"].select("seller_id", "user_id"), "seller_id")
    per_user = owners.groupBy("user_id").agg(F.max_by(
        F.when(F.col("action") == "approve", "seller").otherwise("guest"), F.col("seller_id")).alias("_role"))
    u = t["users"].join(per_user, "user_id", "left")
    hit = F.col("_role").isNotNull()
    u = _touch(u.withColumn("role", F.coalesce("_role", "role")), as_of, hit)
    rejected = actions.where(~F.coalesce(F.col("action").isin("approve", "suspend"), F.lit(False))).withColumn(
        "reason", F.lit("invalid action")).unionByName(
        valid.join(t["sellers"].select("seller_id"), "seller_id", "left_anti").withColumn(
            "reason", F.lit("seller not found")))
    return Change(u.drop("_role"), u.where(hit).drop("_role"), rejected)


def bulk_delete(base: DataFrame, ids: DataFrame, key: str | Sequence[str]) -> Change:
    """T5: remove rows whose key is in ``ids``; ids matching nothing are rejected."""
    keys = [key] if isinstance(key, str) else list(key)
    k = ids.select(*keys).dropDuplicates()
    return Change(base.join(k, keys, "left_anti"), base.join(k, keys, "left_semi"),
                  k.join(base.select(*keys), keys, "left_anti"))


# ---------------------------------------------------------------- T6 cascade

def _topological(keys=FOREIGN_KEYS) -> list[str]:
    children: dict[str, set[str]] = {}
    indeg: dict[str, int] = {}
    for child, _, parent, _, _ in keys:
        if child == parent:
            continue
        children.setdefault(parent, set())
        if child not in children[parent]:
            children[parent].add(child)
            indeg[child] = indeg.get(child, 0) + 1
        indeg.setdefault(parent, indeg.get(parent, 0))
    order, ready = [], sorted(n for n, d in indeg.items() if d == 0)
    while ready:
        n = ready.pop(0)
        order.append(n)
        for c in sorted(children.get(n, ())):
            indeg[c] -= 1
            if indeg[c] == 0:
                ready.append(c)
    return order


class CascadeResult(NamedTuple):
    tables: dict[str, DataFrame]
    deleted: dict[str, DataFrame]
    blocked: DataFrame


class RestrictViolation(Exception):
    pass


def cascade_delete(t: Tables, table: str, ids: DataFrame, on_blocked: str = "fail",
                   keys=FOREIGN_KEYS) -> CascadeResult:
    """Delete ``ids`` from ``table`` and follow the foreign keys: CASCADE
    children are deleted too, RESTRICT / NO ACTION children that would be left
    pointing at a deleted row block the delete.

    Every deleted row carries the root id that reached it, so
    ``on_blocked="skip"`` drops exactly the roots whose cascade is blocked and
    deletes the rest; ``"fail"`` (statement semantics) raises when anything is
    blocked. Restricts are checked on the final key sets before anything is
    removed.
    """
    if on_blocked not in ("fail", "skip"):
        raise ValueError("on_blocked must be 'fail' or 'skip'")
    (root_key,) = PRIMARY_KEYS[table]
    roots = ids.select(F.col(root_key).alias("_root")).dropDuplicates()

    def walk(root_ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame | None]:
        dels: dict[str, DataFrame] = {
            table: t[table].select(*PRIMARY_KEYS[table]).join(
                root_ids.select(F.col("_root").alias(root_key)), root_key, "left_semi").withColumn(
                "_root", F.col(root_key))}
        restrict_hits = []
        checkpoint_root(t[table].sparkSession)
        for parent in _topological(keys):
            if parent not in dels:
                continue
            # All parents of this table come earlier in the order, so its
            # deletion set is final: write it once so children read it back
            # instead of re-deriving it (keeps the plans linear in depth).
            dels[parent] = dels[parent].dropDuplicates().checkpoint(eager=True)
            for child, col, par, pcol, action in keys:
                if par != parent or child not in t:
                    continue
                pk = list(PRIMARY_KEYS[child])
                hit_keys = dels[parent].select(F.col(pcol).alias(col), "_root").dropDuplicates()
                rows = t[child].select(*dict.fromkeys(pk + [col])).join(hit_keys, col)
                if action == "cascade":
                    add = rows.select(*pk, "_root")
                    dels[child] = add if child not in dels else dels[child].unionByName(add)
                else:
                    restrict_hits.append((child, col, parent, rows))
        blocked = None
        for child, col, parent, rows in restrict_hits:
            pk = list(PRIMARY_KEYS[child])
            still = rows.join(dels[child].select(*pk).dropDuplicates(), pk, "left_anti") if child in dels else rows
            b = still.select(F.lit(f"{child}.{col} -> {parent}").alias("constraint"),
                             F.concat_ws("|", *[F.col(k).cast("string") for k in pk]).alias("child_key"), "_root")
            blocked = b if blocked is None else blocked.unionByName(b)
        return dels, blocked

    dels, blocked = walk(roots)
    if blocked is None:
        blocked = t[table].sparkSession.createDataFrame([], "constraint string, child_key string, _root long")
    elif on_blocked == "fail":
        if not blocked.isEmpty():
            raise RestrictViolation("delete blocked by RESTRICT foreign keys")
    else:
        # Sparing a root spares its children, which may block others: repeat
        # until no root is blocked. Every round spares at least one root.
        blocked = blocked.dropDuplicates().checkpoint(eager=True)
        now = blocked
        while not now.isEmpty():
            roots = roots.join(now.select("_root"), "_root", "left_anti").checkpoint(eager=True)
            dels, again = walk(roots)
            now = again.dropDuplicates().checkpoint(eager=True)
            blocked = blocked.unionByName(now)
    blocked = blocked.dropDuplicates()
    new_tables = {}
    deleted = {}
    for name, d in dels.items():
        pk = list(PRIMARY_KEYS[name])
        k = d.select(*pk).dropDuplicates()
        new_tables[name] = t[name].join(k, pk, "left_anti")
        deleted[name] = t[name].join(k, pk, "left_semi")
    return CascadeResult(new_tables, deleted, blocked.withColumnRenamed("_root", "root_id"))


# ---------------------------------------------------------------- T7 merge

def merge_categories(t: Tables, pairs: DataFrame, as_of=None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Merge source categories into targets: products move to the final
    target (chains a->b->c are followed) and get updated_at = as_of, sources
    are removed, no product is lost. Rejected: source = target, unknown source
    or target, a source with two targets, cycles. Returns ({categories,
    products}, rejected).

    Chains are followed by pointer doubling: after k rounds every pair points
    2 ** k steps ahead, so log2(pairs) rounds decide every pair; what still
    points at a source then runs into a cycle."""
    cats = t["categories"].select("category_id")
    p = pairs.select(F.col("source_id").cast("long"), F.col("target_id").cast("long"))
    targets = p.groupBy("source_id").agg(F.count_distinct("target_id").alias("_n"))
    known = cats.select("category_id", F.lit(True).alias("_k"))
    p = (p.join(targets, "source_id", "left")
         .join(known.select(F.col("category_id").alias("source_id"), F.col("_k").alias("_s")), "source_id", "left")
         .join(known.select(F.col("category_id").alias("target_id"), F.col("_k").alias("_t")), "target_id", "left"))
    reason = (F.when(F.col("source_id") == F.col("target_id"), "source equals target")
              .when(F.col("_s").isNull(), "source not found").when(F.col("_t").isNull(), "target not found")
              .when(F.col("_n") > 1, "several targets"))
    checkpoint_root(p.sparkSession)
    p = p.select("source_id", "target_id", reason.alias("reason")).checkpoint(eager=True)
    rejected = p.where(F.col("reason").isNotNull())
    ok = p.join(rejected.select("source_id"), "source_id", "left_anti").select("source_id", "target_id").dropDuplicates()
    sources = ok.select("source_id")

    ahead = ok.select("source_id", F.col("target_id").alias("final_id")).checkpoint(eager=True)
    for _ in range(max(1, ahead.count()).bit_length()):
        jump = ahead.select(F.col("source_id").alias("_via"), F.col("final_id").alias("_next"))
        ahead = (ahead.join(jump, F.col("final_id") == F.col("_via"), "left")
                 .select("source_id", F.coalesce("_next", "final_id").alias("final_id")).checkpoint(eager=True))
        open_ = ahead.join(sources.select(F.col("source_id").alias("final_id")), "final_id", "left_semi")
        if open_.isEmpty():
            break
    looping = open_.select("source_id")
    rejected = rejected.unionByName(ok.join(looping, "source_id", "left_semi").withColumn("reason", F.lit("cycle")))
    final = ahead.join(looping, "source_id", "left_anti")
    products = t["products"].join(final.withColumnRenamed("source_id", "category_id"), "category_id", "left")
    products = _touch(products, as_of, F.col("final_id").isNotNull())
    products = (products.withColumn("category_id", F.coalesce("final_id", "category_id")).drop("final_id")
                .select(*t["products"].columns))
    categories = t["categories"].join(final.select(F.col("source_id").alias("category_id")), "category_id",
                                      "left_anti")
    return {"categories": categories, "products": products}, rejected


# ---------------------------------------------------------------- T8 - T10 carts

class CartAdds(NamedTuple):
    cart_items: DataFrame
    carts: DataFrame
    decisions: DataFrame


def _fold_adds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Accept adds in order while they fit. Rows come sorted by key and seq;
    the state is the current key and what is left of its capacity."""
    key, left = None, 0
    for batch in batches:
        cart, product, seq, quantity, cap = (batch.column(i).to_pylist() for i in range(5))
        accepted = []
        for k, q, c in zip(zip(cart, product), quantity, cap):
            if k != key:
                key, left = k, c
            fits = q <= left
            if fits:
                left -= q
            accepted.append(fits)
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(accepted, pa.bool_())], names=["seq", "accepted"])


def cart_add_decisions(adds: DataFrame, capacity: DataFrame) -> DataFrame:
    """Greedy in-order acceptance per (cart, product): an add of q is accepted
    when q fits into the remaining capacity (stock - quantity already in the
    cart), and then uses it up; otherwise it is rejected and the capacity is
    unchanged.

    A key whose adds fit together is settled by its total. The rows of the
    other keys are sorted by key and seq inside their partition and folded in
    one pass whose state is one number, whatever the number of rows of a key;
    the number of jobs does not depend on the data.
    ``adds``: seq, cart_id, product_id, quantity. ``capacity``: cart_id,
    product_id, cap. Returns seq, accepted.
    """
    keys = ["cart_id", "product_id"]
    a = adds.select("seq", *keys, "quantity")
    sums = a.groupBy(*keys).agg(F.sum("quantity").alias("_all")).join(capacity, keys)
    rows = a.join(sums, keys)
    settled = rows.where(F.col("_all") <= F.col("cap")).select("seq", F.lit(True).alias("accepted"))
    folded = (rows.where(F.col("_all") > F.col("cap"))
              .select(*[F.col(c).cast("long").alias(c) for c in (*keys, "seq", "quantity", "cap")])
              .repartition(*keys).sortWithinPartitions(*keys, "seq")
              .mapInArrow(_fold_adds, "seq long, accepted boolean"))
    return settled.unionByName(folded)


def apply_cart_adds(t: Tables, adds: DataFrame, as_of) -> CartAdds:
    """Add products to carts in arrival order (``seq``).

    Per (cart, product) the quantity accumulates from the existing cart line;
    an add is refused with 'Insufficient stock' when stock < current + new.
    Accepted adds set the line's unit price to the current selling price (F5);
    new lines get keys after the current maximum; touched carts get
    updated_at = as_of. Unknown products ('Product not found') and unknown
    carts ('Cart not found') are refused.
    """
    keys = ["cart_id", "product_id"]
    items = t["cart_items"]
    prod = t["products"].select("product_id", "stock", selling_price().alias("_price"))
    a = adds.select("seq", *keys, "quantity")
    known = (a.join(prod.select("product_id"), "product_id", "left_semi").join(t["carts"].select("cart_id"), "cart_id", "left_semi")
             .where(F.col("quantity") > 0))
    existing = items.select(*keys, F.col("quantity").alias("_have"))
    cap = (known.select(*keys).dropDuplicates().join(prod.select("product_id", "stock"), "product_id")
           .join(existing, keys, "left").select(*keys, (F.col("stock") - F.coalesce("_have", F.lit(0))).alias("cap")))
    dec = cart_add_decisions(known, cap)
    decisions = (a.join(dec, "seq", "left")
                 .join(prod.select("product_id", F.lit(True).alias("_known")), "product_id", "left")
                 .join(t["carts"].select("cart_id", F.lit(True).alias("_cart")), "cart_id", "left")
                 .withColumn("reason", F.when(F.col("_known").isNull(), "Product not found")
                             .when(F.col("_cart").isNull(), "Cart not found")
                             .when(F.coalesce(F.col("quantity") <= 0, F.lit(True)), "Quantity must be positive")
                             .when(~F.coalesce("accepted", F.lit(False)), "Insufficient stock"))
                 .withColumn("accepted", F.coalesce("accepted", F.lit(False))).drop("_known", "_cart"))
    gained = (decisions.where("accepted").groupBy(*keys).agg(F.sum("quantity").alias("_add"),
                                                             F.min("seq").alias("_first"))
              .join(prod.select("product_id", "_price"), "product_id"))
    upd = items.join(gained, keys, "left")
    hit = F.col("_add").isNotNull()
    updated = upd.select(*[
        (F.when(hit, F.col("quantity") + F.col("_add")).otherwise(F.col("quantity")).cast("int").alias(c)
         if c == "quantity" else
         F.when(hit, F.col("_price")).otherwise(F.col("unit_price")).alias(c) if c == "unit_price" else F.col(c))
        for c in items.columns])
    fresh = gained.join(items.select(*keys), keys, "left_anti").select(
        *keys, F.col("_add").cast("int").alias("quantity"), F.col("_price").alias("unit_price"),
        ts_lit(as_of).alias("added_at"), F.col("_first").alias("seq"))
    start = F.coalesce(items.select(F.max("cart_item_id")).scalar(), F.lit(0))
    fresh = assign_keys(fresh.orderBy("seq"), "cart_item_id", start).select(*items.columns)
    carts = _touch(t["carts"].join(_flag(gained, ["cart_id"]), "cart_id", "left"), as_of,
                   F.col("_hit").isNotNull()).drop("_hit")
    return CartAdds(updated.unionByName(fresh), carts, decisions)


def set_cart_quantities(t: Tables, sets: DataFrame, as_of) -> CartAdds:
    """Set line quantities. Every request is decided by itself: refused when
    the quantity is not positive ('Quantity must be positive') or above stock
    ('Insufficient stock'), or the line is unknown; of a line's accepted
    requests the last by seq stands. Touches the carts of changed lines."""
    items = t["cart_items"]
    lines = (items.select("cart_item_id", "cart_id", "product_id")
             .join(t["products"].select("product_id", "stock"), "product_id", "left"))
    q = F.col("quantity")
    reason = (F.when(F.col("cart_id").isNull(), "Cart item not found")
              .when(q.isNull() | (q <= 0), "Quantity must be positive")
              .when(F.col("stock").isNull() | (q > F.col("stock")), "Insufficient stock"))
    decisions = (sets.select("seq", "cart_item_id", "quantity").join(lines, "cart_item_id", "left")
                 .select("seq", "cart_item_id", "quantity", reason.alias("reason"), reason.isNull().alias("accepted")))
    ok = decisions.where("accepted").groupBy("cart_item_id").agg(F.max_by("quantity", "seq").alias("_q"))
    new_items = (items.join(ok, "cart_item_id", "left")
                 .withColumn("quantity", F.coalesce("_q", "quantity").cast("int")).drop("_q"))
    touched = ok.join(items.select("cart_item_id", "cart_id"), "cart_item_id").select("cart_id")
    return CartAdds(new_items.select(*items.columns), _touch_carts(t, touched, as_of), decisions)


def _touch_carts(t: Tables, cart_ids: DataFrame, as_of) -> DataFrame:
    return _touch(t["carts"].join(_flag(cart_ids, ["cart_id"]), "cart_id", "left"), as_of,
                  F.col("_hit").isNotNull()).drop("_hit")


def remove_cart_items(t: Tables, item_ids: DataFrame, as_of) -> CartAdds:
    """Remove single cart lines (cart_item_id) and touch their carts.
    ``decisions`` has every id asked for and whether its line was there."""
    items = t["cart_items"]
    k = item_ids.select("cart_item_id").dropDuplicates()
    gone = items.join(k, "cart_item_id", "left_semi")
    there = k.join(items.select("cart_item_id", F.lit(True).alias("_there")), "cart_item_id", "left")
    decisions = there.select("cart_item_id", F.when(F.col("_there").isNull(), "Cart item not found").alias("reason"),
                             F.col("_there").isNotNull().alias("accepted"))
    return CartAdds(items.join(k, "cart_item_id", "left_anti"), _touch_carts(t, gone.select("cart_id"), as_of), decisions)


def clear_carts(t: Tables, cart_ids: DataFrame, as_of) -> CartAdds:
    """Remove every line of the given carts and touch the carts."""
    k = cart_ids.select("cart_id").dropDuplicates()
    items = t["cart_items"]
    carts = _touch(t["carts"].join(_flag(k, ["cart_id"]), "cart_id", "left"), as_of,
                   F.col("_hit").isNotNull()).drop("_hit")
    return CartAdds(items.join(k, "cart_id", "left_anti"), carts, items.join(k, "cart_id", "left_semi"))


def claim_carts(t: Tables, claims: DataFrame, as_of=None) -> Change:
    """A guest cart (by session id) becomes the user's cart: user set,
    session cleared. Claims without a user, by an unknown user or of a session
    that has no guest cart are rejected with the reason; of a session's other
    claims the last by seq wins."""
    carts = t["carts"]
    guests = carts.where(F.col("user_id").isNull() & F.col("session_id").isNotNull()).select("session_id").dropDuplicates()
    known = t["users"].select("user_id", F.lit(True).alias("_user"))
    asked = (claims.join(known, "user_id", "left").join(guests.withColumn("_cart", F.lit(True)), "session_id", "left")
             .withColumn("reason", F.when(F.col("_cart").isNull(), "Cart not found")
                         .when(F.col("user_id").isNull(), "user_id is required")
                         .when(F.col("_user").isNull(), "missing users")))
    last = asked.where(F.col("reason").isNull()).groupBy("session_id").agg(F.max_by("user_id", "seq").alias("_uid"))
    j = carts.join(last, "session_id", "left").withColumn("_h", F.col("_uid").isNotNull() & F.col("user_id").isNull())
    hit = F.col("_h")
    out = (j.withColumn("user_id", F.when(hit, F.col("_uid")).otherwise(F.col("user_id")))
           .withColumn("session_id", F.when(hit, F.lit(None).cast("string")).otherwise(F.col("session_id"))))
    out = _touch(out, as_of, hit)
    return Change(out.drop("_uid", "_h").select(*carts.columns), out.where("_h").drop("_uid", "_h"),
                  asked.where(F.col("reason").isNotNull()).select(*claims.columns, "reason"))


# ---------------------------------------------------------------- T11 payments

def _decided(decisions: DataFrame, payments: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Valid decisions, and the others with the reason."""
    known = payments.select(F.col(key)).dropDuplicates().withColumn("_known", F.lit(True))
    d = decisions.join(known, key, "left").withColumn(
        "reason", F.when(F.col("is_confirmed").isNull(), "is_confirmed is required")
        .when(F.col("_known").isNull(), "payment not found")).drop("_known")
    return d.where(F.col("reason").isNull()).drop("reason"), d.where(F.col("reason").isNotNull())


def _confirmed(payments: DataFrame, valid: DataFrame, key: str, as_of) -> DataFrame:
    last = valid.groupBy(key).agg(F.max_by("is_confirmed", "seq").alias("_d"))
    pay = payments.join(last, key, "left")
    hit = F.col("_d").isNotNull()
    return (pay.withColumn("is_confirmed", F.when(hit, F.col("_d")).otherwise(F.col("is_confirmed")))
            .withColumn("confirmed_at", F.when(hit, F.when(F.col("_d"), ts_lit(as_of))).otherwise(F.col("confirmed_at")))
            .select(*payments.columns))


def confirm_payments(t: Tables, decisions: DataFrame, as_of) -> tuple[dict[str, DataFrame], DataFrame]:
    """Admin confirmation (payment_id, is_confirmed, notes, seq): payment
    flag and confirmed_at (as_of or NULL); the order becomes processing or
    failed and its notes get ' | Admin note: ...' (or ' | ' alone) for every
    decision, in seq order; the last decision stands. Unknown payments and
    decisions without is_confirmed are rejected. Both tables change together
    (publish with S3)."""
    valid, rejected = _decided(decisions, t["payments"], "payment_id")
    note = F.when(F.coalesce(F.col("notes"), F.lit("")) != "", F.concat(F.lit("Admin note: "), F.col("notes"))) \
        .otherwise(F.lit(""))
    per_order = (valid.join(t["payments"].select("payment_id", "order_id"), "payment_id")
                 .groupBy("order_id").agg(
                     F.max_by("is_confirmed", "seq").alias("_ok"),
                     F.sort_array(F.collect_list(F.struct("seq", append_note(F.lit(""), note).alias("n")))).alias("_notes")))
    o = t["orders"].join(per_order, "order_id", "left")
    oh = F.col("_ok").isNotNull()
    o = (o.withColumn("status", F.when(oh, F.when(F.col("_ok"), "processing").otherwise("failed"))
                      .otherwise(F.col("status")))
         .withColumn("notes", F.when(oh, F.concat(F.coalesce("notes", F.lit("")), F.array_join(F.col("_notes.n"), "")))
                     .otherwise(F.col("notes"))))
    o = _touch(o, as_of, oh)
    return ({"payments": _confirmed(t["payments"], valid, "payment_id", as_of),
             "orders": o.select(*t["orders"].columns)}, rejected)


def confirm_payments_by_order(t: Tables, decisions: DataFrame, as_of) -> Change:
    """T11 by order (order_id, is_confirmed, seq): only the payment changes."""
    valid, rejected = _decided(decisions, t["payments"], "order_id")
    table = _confirmed(t["payments"], valid, "order_id", as_of)
    return Change(table, table.join(valid.select("order_id"), "order_id", "left_semi"), rejected)


# ---------------------------------------------------------------- T12 reviews

class ReviewChange(NamedTuple):
    reviews: DataFrame
    products: DataFrame
    rejected: DataFrame


def apply_reviews(t: Tables, changes: DataFrame, as_of) -> ReviewChange:
    """Review creates, updates and deletes (op, seq, review_id, user_id,
    product_id, rating, comment) in seq order, then new rating and count for
    the touched products only.

    * create: one review per (user, product): refused while one exists or once
      an earlier create of the batch took the pair; a pair is free again after
      its review was deleted. Unknown users and products and forbidden ratings
      are refused. New ids after the maximum; created_at = as_of.
    * update: only by the author, before a delete of that review; rating and
      comment when given (last by seq wins); forbidden ratings are refused;
      created_at = as_of (as the reference does).
    * delete: only by the author; the first one counts.
    * any other op is refused.
    A refused change touches nothing. Products of accepted ones: rating = average rounded to 2 places, 0 with no reviews left;
    review_count; updated_at = as_of.
    """
    from storefront.operators.metrics import product_ratings
    reviews = t["reviews"]
    owner = reviews.select("review_id", F.col("user_id").alias("_author"))
    ud = changes.where(F.col("op").isin("update", "delete")).join(owner, "review_id", "left")
    gone = (ud.where((F.col("op") == "delete") & (F.col("_author") == F.col("user_id")))
            .groupBy("review_id").agg(F.min("seq").alias("_gone")))
    ud = ud.join(gone, "review_id", "left")
    late = F.coalesce(F.col("seq") > F.col("_gone"), F.lit(False))
    ud = ud.withColumn("reason", F.when(F.col("_author").isNull() | late, "review not found")
                       .when(F.coalesce(F.col("_author") != F.col("user_id"), F.lit(True)), "not the author"))
    ud_ok = ud.where(F.col("reason").isNull())
    up = ud_ok.where(F.col("op") == "update").select(
        "seq", "review_id", "rating", "comment",
        F.array_compact(F.array(F.when(F.col("rating").isNotNull(), F.lit("rating")),
                                F.when(F.col("comment").isNotNull(), F.lit("comment")),
                                F.lit("created_at"))).alias("changed"),
        ts_lit(as_of).alias("created_at"))
    patched = patch(reviews, up, "review_id", "present", name="reviews")
    left = patched.table.join(gone, "review_id", "left_anti")

    # A pair is free after the delete of its last review, never while one stays.
    pair = ["user_id", "product_id"]
    freed = (reviews.select("review_id", *pair).join(gone, "review_id", "left").groupBy(*pair)
             .agg(F.max("_gone").alias("_free"), F.count_if(F.col("_gone").isNull()).alias("_stay")))
    cr = changes.where(F.col("op") == "create").select("seq", *pair, "rating", "comment").join(freed, pair, "left")
    taken = F.coalesce((F.col("_stay") > 0) | (F.col("seq") < F.col("_free")), F.lit(False))
    # A taken pair is refused after the row's own faults, as on an insert.
    own_fault = _missing_parents(cr.withColumn("reason", first_reason(
        [x for x in table_rules("reviews", cr.columns) if x[0] != "review_id_not_null"])), "reviews", t, cr.columns)
    cr = own_fault.withColumn("reason", F.coalesce("reason", F.when(taken, "duplicate " + ",".join(pair))))
    # Written once: the insert reads these rows several times, and a task would
    # hold the joins and sorts of all those readings at once.
    checkpoint_root(cr.sparkSession)
    cr = cr.drop("_stay", "_free").checkpoint(eager=True)
    ins = insert_rows(left, cr.where(F.col("reason").isNull()).select("seq", *pair, "rating", "comment"), "reviews",
                      defaults={"created_at": "as_of"}, as_of=as_of)
    # New ids follow the old maximum even if that review was deleted.
    new = ins.affected
    top, kept = reviews.select(F.max("review_id")).scalar(), left.select(F.max("review_id")).scalar()
    new = new.withColumn("review_id", F.col("review_id") + F.coalesce(top, F.lit(0)) - F.coalesce(kept, F.lit(0)))
    rv = left.unionByName(new.select(*left.columns))

    deleted = reviews.join(gone, "review_id", "left_semi")
    touched = (new.select("product_id").unionByName(patched.affected.select("product_id"))
               .unionByName(deleted.select("product_id")).dropDuplicates())
    ratings = product_ratings(rv.join(touched, "product_id", "left_semi"), touched)
    p = t["products"].join(ratings.withColumnRenamed("rating", "_r").withColumnRenamed("review_count", "_n")
                           .withColumn("_hit", F.lit(True)), "product_id", "left")
    hit = F.col("_hit").isNotNull()
    p = (p.withColumn("rating", F.when(hit, F.col("_r")).otherwise(F.col("rating")))
         .withColumn("review_count", F.when(hit, F.col("_n")).otherwise(F.col("review_count"))))
    p = _touch(p, as_of, hit).select(*t["products"].columns)
    unknown = changes.where(~F.coalesce(F.col("op").isin("create", "update", "delete"), F.lit(False)))
    rejected = (ins.rejected.select("seq", "reason")
                .unionByName(unknown.select("seq", F.lit("unknown op").alias("reason")))
                .unionByName(cr.where(F.col("reason").isNotNull()).select("seq", "reason"))
                .unionByName(ud.where(F.col("reason").isNotNull()).select("seq", "reason"))
                .unionByName(patched.rejected.select("seq", "reason")))
    return ReviewChange(rv.select(*reviews.columns), p, rejected)


# ---------------------------------------------------------------- T13 images

def set_primary_images(images: DataFrame, requests: DataFrame) -> Change:
    """Make the requested image the only primary one of its product (last
    request per product wins); requests naming an image of another product
    or an unknown image are rejected."""
    valid = requests.join(images.select("image_id", "product_id"), ["image_id", "product_id"], "left_semi")
    chosen = valid.groupBy("product_id").agg(F.max_by("image_id", "seq").alias("_chosen"))
    j = images.join(chosen, "product_id", "left")
    hit = F.col("_chosen").isNotNull()
    out = j.withColumn("is_primary", F.when(hit, F.col("image_id") == F.col("_chosen")).otherwise(F.col("is_primary")))
    return Change(out.drop("_chosen").select(*images.columns), out.where(hit).drop("_chosen"),
                  requests.join(valid.select("seq"), "seq", "left_anti"))


# ---------------------------------------------------------------- T14 - T16 transactions

# The timeout result written by the stale sweep.
TIMEOUT_CODE = "TIMEOUT"
TIMEOUT_DESC = "Transaction timeout - no response from M-Pesa"


def sweep_stale(txns: DataFrame, as_of, minutes: int = 30) -> Change:
    """Pending transactions older than ``minutes`` become failed with the
    TIMEOUT code and text; updated_at = as_of."""
    stale = (F.col("status") == "pending") & (F.col("created_at") < ago(as_of, minutes=minutes))
    out = txns.withColumn("_s", F.coalesce(stale, F.lit(False)))
    s = F.col("_s")
    out = (out.withColumn("status", F.when(s, "failed").otherwise(F.col("status")))
           .withColumn("result_code", F.when(s, TIMEOUT_CODE).otherwise(F.col("result_code")))
           .withColumn("result_desc", F.when(s, TIMEOUT_DESC).otherwise(F.col("result_desc")))
           .withColumn("updated_at", F.when(s, ts_lit(as_of)).otherwise(F.col("updated_at"))))
    return Change(out.drop("_s"), out.where(s).drop("_s"), txns.limit(0))


def update_transaction_status(txns: DataFrame, updates: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Status updates by checkout id (checkout_request_id, status,
    mpesa_receipt_number, result_code, result_desc, seq): status is set, the
    other fields keep their old value when the update has NULL; updated_at =
    as_of. An update that the table's rules forbid (another status, a text that
    is too long) changes nothing. Returns (new table, one result per update:
    checkout_request_id, seq, success, message, transaction_id)."""
    cols = ["status", "mpesa_receipt_number", "result_code", "result_desc"]
    up = updates.select("checkout_request_id", "seq", *cols).withColumn(
        "changed", F.array_compact(F.array(F.lit("status"), *[F.when(F.col(c).isNotNull(), F.lit(c))
                                                               for c in cols[1:]])))
    # The rules of the columns an update writes; the rest of the row is not its matter.
    rules = [r for r in table_rules("mpesa_transactions", cols) if r[0].startswith(tuple(cols))]
    decided = up.withColumn("reason", first_reason(rules))
    ch = patch(txns, decided.where(F.col("reason").isNull()).drop("reason"), "checkout_request_id", "present", as_of=as_of)
    found = decided.join(txns.select("checkout_request_id", "transaction_id"), "checkout_request_id", "left")
    ok = F.col("transaction_id").isNotNull() & F.col("reason").isNull()
    message = (F.when(F.col("transaction_id").isNull(), "Transaction not found")
               .when(F.col("reason").isNotNull(), F.concat(F.lit("Transaction update refused: "), "reason"))
               .otherwise("Transaction updated successfully"))
    results = found.select("checkout_request_id", "seq", ok.alias("success"), message.alias("message"), "transaction_id")
    return ch.table, results


def register_payments(t: Tables, requests: DataFrame, as_of) -> Change:
    """Payment requests (request_id, phone_number, amount, order_id,
    checkout_request_id, merchant_request_id) are validated in the
    reference's order: missing field, bad phone (F2), amount < 1, order not
    found, amount differs from the order total by more than 0.01. Valid ones
    become pending transactions through the checked insert (raw phone text
    stored, created_at = as_of, ids after the current maximum; a checkout id
    that is taken, or taken earlier in the batch, is refused); the others are
    rejected with the reason."""
    txns = t["mpesa_transactions"]
    r = requests.join(t["orders"].select("order_id", F.col("total_amount").alias("_total")), "order_id", "left")
    missing = (F.col("phone_number").isNull() | (F.col("phone_number") == "") | F.col("amount").isNull()
               | (F.col("amount") == 0) | F.col("order_id").isNull())
    reason = (F.when(missing, "Phone number, amount, and order ID are required")
              .when(~valid_phone("phone_number"), "Invalid phone number format")
              .when(F.col("amount") < 1, "Amount must be at least KSh 1")
              .when(F.col("_total").isNull(), "Order not found")
              .when(~amount_matches(F.col("amount"), F.col("_total")), "Payment amount does not match order total"))
    r = r.withColumn("reason", reason)
    good = r.where(F.col("reason").isNull()).select(
        "order_id", "checkout_request_id", "merchant_request_id", "phone_number",
        F.col("amount").cast("decimal(12,2)").alias("amount"), F.lit("pending").alias("status"),
        ts_lit(as_of).alias("created_at"), ts_lit(as_of).alias("updated_at"), "request_id")
    ins = insert_rows(txns, good, "mpesa_transactions", as_of=as_of, seq="request_id")
    refused = r.join(ins.rejected.select("request_id", F.col("reason").alias("_why")), "request_id", "left")
    refused = refused.withColumn("reason", F.coalesce("reason", "_why")).where(F.col("reason").isNotNull())
    return Change(ins.table, ins.affected, refused.drop("_total", "_why"))
