"""Exact, near and line dedup against brute force, edge cases included."""

import hashlib
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from storefront.llm import decontaminate, exact_dedup, line_dedup, near_dedup, setsketch, toxicity
from storefront.llm.components import components
from storefront.llm.cuckoo import CuckooFilter, FilterFull, filter_of


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def want_exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(brute.low(t), []).append(d)
    out = []
    for d, t in rows:
        g = groups[brute.low(t)]
        ids = [x for x in g if x is not None]
        keep = max(ids) if ids else None
        out.append((d, keep, len(g), d == keep, hashlib.sha256(brute.low(t)).hexdigest()))
    return brute.class_sort(out)


def got_exact(df, **kw):
    return brute.class_sort(tuple(r) for r in exact_dedup.exact_duplicates(df, **kw).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


# keys of 3 bits make different blocks meet; blocks of 16 bytes make many rounds
@pytest.mark.parametrize("kw", [{}, {"block_bytes": 1024, "key_bits": 3}])
def test_exact_edge_cases(edge, kw):
    assert got_exact(edge, **kw) == want_exact(rows_of(edge))


def test_exact_names_are_collision_free(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abAB") for _ in range(rng.randrange(0, 12)))) for i in range(150)]
    df = frame(spark, rows)
    assert got_exact(df, block_bytes=2, key_bits=2) == want_exact(rows)


def test_exact_names_do_not_depend_on_partitions(spark, docs001):
    a, b = (exact_dedup.text_identities(docs001.repartition(n), 512).select("doc_id", "rounds", "name").orderBy("doc_id").collect()
            for n in (1, 7))
    assert a == b


def test_near_edge_cases(edge):
    rows = rows_of(edge)
    for k in (4, 5):
        want = brute.class_sort((rows[i][0], n, c if n else rows[i][0]) for i, (n, c) in brute.components(rows, k).items())
        got = near_dedup.near_duplicates(edge, shingle=k).select("doc_id", "n_shingles", "component_id", "kept").collect()
        assert brute.class_sort((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def near_family(rng, start, size, edits, n=90):
    """Texts that differ from a base in a few words each."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    out = []
    for i in range(size):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
        out.append((start + i, " ".join(w)))
    return out


def test_near_families_around_the_threshold(spark):
    rng = random.Random(8)
    rows = near_family(rng, 0, 60, 1) + near_family(rng, 100, 60, 2) + near_family(rng, 200, 60, 3)
    rows += [(400 + i, rows[3][1]) for i in range(40)]
    # a chain: each text shares most of its words with the next one only
    words = [f"c{i}" for i in range(400)]
    rows += [(500 + i, " ".join(words[6 * i:6 * i + 120])) for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, rows), shingle=4).collect()}
    want = {rows[i][0]: v for i, v in brute.components(rows, 4).items()}
    assert got == want


def test_pairs_of_far_copies_do_not_grow_with_the_square(spark, monkeypatch):
    """Copies of one text that are too far from each other to be linked: buckets hold most of their pairs."""
    rows = near_family(random.Random(5), 0, 200, 3)
    asked = []
    links = near_dedup._Verifier.links

    def counted(self, pairs, label):
        asked.append(pairs.count())
        return links(self, pairs, label)

    monkeypatch.setattr(near_dedup._Verifier, "links", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, rows), shingle=4).collect()}
    assert got == {rows[i][0]: v for i, v in brute.components(rows, 4).items()}
    assert sum(asked) <= 24 * len(rows)


def test_near_dedup_on_driver_documents(docs001):
    rows = rows_of(docs001)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs001, shingle=4).collect()}
    assert got == {rows[i][0]: v for i, v in brute.components(rows, 4).items()}
    kept = {r.doc_id for r in near_dedup.keep_first(docs001, shingle=5).collect()}
    assert kept == {rows[i][0] for i, (n, c) in brute.components(rows, 5).items() if not n or c == rows[i][0]}


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(80)]
    edges += [(600, 600 + i) for i in range(1, 50)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(top)}


def test_sketch_agreement_and_estimate_follow_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        union = rng.integers(0, 2**63, 400 * 60).astype(np.uint64).reshape(60, 400)
        both = int(400 * share)
        sets = [s for u in union for s in (np.unique(u[:both + (400 - both) // 2]), np.unique(np.concatenate([u[:both], u[both + (400 - both) // 2:]])))]
        k = setsketch.sketches(sets, 96)
        sizes = np.array([len(s) for s in sets], float)
        j = setsketch.joint_estimate(k[::2], k[1::2], sizes[::2], sizes[1::2])
        assert abs(j.mean() - share) < 0.02
        assert abs((k[::2] == k[1::2]).mean() - share) < 0.02


def test_sketches_merge_by_maximum():
    rng = np.random.default_rng(3)
    a, b = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (50, 700))
    one = setsketch.sketches([a, b, np.union1d(a, b)], 32)
    assert (np.maximum(one[0], one[1]) == one[2]).all()


def got_lines(df, index=None):
    index = index or line_dedup.build_index(df)
    return brute.class_sort((r.doc_id, r.line_count, r.dropped_count, r.text) for r in line_dedup.rewrite(
        df.select("doc_id", "text"), index).collect())


def test_line_edge_cases(edge):
    assert got_lines(edge) == brute.class_sort(brute.line_dedup(rows_of(edge)))
    kept = line_dedup.drop_repeated_lines(edge)
    assert kept.columns == edge.columns and kept.count() == edge.count()


def line_rows(rng, ids, lines):
    return [(d, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 6)))) for d in ids]


def test_line_index_is_reversible(spark):
    rng = random.Random(5)
    lines = [f"a line with number {i} that may repeat" for i in range(40)] + ["short", ""]
    first, second = line_rows(rng, range(60), lines), line_rows(rng, range(60, 90), lines)
    index = line_dedup.build_index(frame(spark, first))
    grown = line_dedup.insert(index, frame(spark, second))
    both = frame(spark, first + second)
    assert got_lines(both, grown) == brute.class_sort(brute.line_dedup(first + second))
    back = line_dedup.delete(grown, spark.createDataFrame([(d,) for d, _ in second], "doc_id long"))
    assert got_lines(frame(spark, first), back) == got_lines(frame(spark, first), index)
    for a, b in ((index.refs, back.refs), (index.counts, back.counts)):
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a.select(*b.columns)).isEmpty()
    less = line_dedup.delete(index, spark.createDataFrame([(d,) for d in range(0, 60, 2)], "doc_id long"))
    rest = [r for r in first if r[0] % 2]
    assert got_lines(frame(spark, rest), less) == brute.class_sort(brute.line_dedup(rest))


def test_cold_lines_go_through_the_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 4)  # hot: a quarter of all references
    rng = random.Random(6)
    rows = line_rows(rng, range(80), [f"a line with number {i} that may repeat" for i in range(30)])
    rows += [(None, rows[0][1]), (2**60 + 1, rows[1][1])]
    assert got_lines(frame(spark, rows)) == brute.class_sort(brute.line_dedup(rows))


def test_cuckoo_filter_has_no_false_negatives_and_forgets():
    rng = np.random.default_rng(0)
    k1, k2 = rng.integers(-2**63, 2**63, 3000), rng.integers(-2**63, 2**63, 3000)
    f = filter_of(k1, k2)
    assert f.contains(k1, k2).all()
    f = CuckooFilter(slots=f.to_bytes())
    f.delete(k1[:2000], k2[:2000])
    assert f.contains(k1[2000:], k2[2000:]).all()
    assert f.contains(k1[:2000], k2[:2000]).mean() < 0.01
    with pytest.raises(FilterFull):
        CuckooFilter(16).insert(k1, k2)


def test_empty_tables(empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.keep_first(empty).columns == empty.columns
    index = line_dedup.build_index(empty)
    assert line_dedup.rewrite(empty, index).count() == 0
    grown = line_dedup.insert(index, empty.sparkSession.createDataFrame([(1, "x" * 30), (2, "x" * 30), (3, "x" * 30)], "doc_id long, text string"))
    assert grown.counts.select(F.max("docs")).first()[0] == 3 and grown.filters.count() == 1


def test_filters_go_by_row_not_by_doc_id(spark, docs001, sf001):
    """Rows without an id, or with one id, stay or go each on its own."""
    words = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(4)]
    item = " ".join(f"item{i}" for i in range(12))
    rows = [(None, words[0], 1), (None, f"{words[1]} {item}", 2), (7, words[2], 3), (7, f"{item} tail", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.n for r in decontaminate.clean_rows(docs, bench).collect()} == {1, 3}

    t1, t2 = words[0], words[1]
    docs = spark.createDataFrame([(3, t1, 1), (5, t1 + " more", 2), (5, t2, 3), (8, t2 + " more", 4),
                                  (None, words[2], 5), (None, words[2], 6), (None, words[3], 7), (None, None, 8), (None, "", 9)],
                                 "doc_id long, text string, n int")
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    got = {r.n for r in kept.collect()}
    assert got - {5, 6} == {1, 3, 7, 8, 9} and len(got & {5, 6}) == 1

    labels = spark.read.parquet(f"{sf001}/labels.parquet")
    model = toxicity._fitted(docs001, labels)
    scored = toxicity.score_toxicity(docs001, model).filter("doc_id is not null").collect()
    toxic = {r.doc_id for r in scored if r.score >= 0.5}
    assert toxic
    # Every id away, but for rows that are learned from: the verdicts must not change.
    blank = docs001.withColumn("old", F.col("doc_id")).withColumn("doc_id", F.when(F.lit(False), F.col("doc_id")))
    both = blank.unionByName(docs001.withColumn("old", F.col("doc_id")))
    left = toxicity.drop_toxic(both, labels).filter("doc_id is null").collect()
    assert {r.old for r in left} == {r.doc_id for r in scored} - toxic
