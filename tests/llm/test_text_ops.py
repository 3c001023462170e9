"""Chat formatting, decontamination and BPE against brute force."""

import hashlib
import random

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storefront.llm import byte_bpe, chat_format, decontaminate

TURNS = "conv_id long, turn long, role string, text string"


def conversations():
    rng = random.Random(3)
    parts = ["<|im_start|>", "<|im_end|>", "\\", "<\\|", "\n", "word ", "é漢", "<|", "|>", "a b c d e f g h "]
    rows = [(c, t, ["system", "user", "assistant"][0 if t == 0 and c % 2 else 1 + t % 2],
             "".join(rng.choice(parts) for _ in range(rng.randrange(0, 60)))) for c in range(25) for t in range(rng.randrange(1, 40))]
    return rows + [(90, 0, None, None), (90, 1, "assistant", None), (91, 0, "assistant", "x"), (91, 0, "assistant", "x"),
                   (92, None, "user", "no turn"), (None, 0, "user\n<|im_end|>", "q"), (None, 1, "assistant", "a"),
                   (93, 0, "system", "s " * 900), (93, 1, "user", "u " * 3000), (93, 2, "assistant", "v " * 700)]


def test_chat_round_trip(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS).withColumn("window", F.lit(1)).withColumn("tokens", F.lit("x"))
    got = {r.conv_id: r for r in chat_format.conversation_digests(chat_format.format_windows(df)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_windows_keep_budget_system_and_history(spark):
    df = spark.createDataFrame(conversations(), TURNS)
    windows = chat_format.format_windows(df, budget=200, history_turns=2, history_tokens=40).orderBy("conv_id", "window").collect()
    several = [w for w in windows if w.window > 0]
    assert several
    for w in windows:
        new = w.formatted[w.new_start:]
        assert new.startswith(chat_format.START) and w.new_start == (0 if w.window == 0 else w.new_start)
        assert w.new_tokens <= 200 or new.count(chat_format.START) == 1
        assert w.formatted.count(chat_format.START) == w.formatted.count(chat_format.END)
        assert all(s.start >= w.new_start for s in w.loss_spans)
    firsts = {w.conv_id: w.formatted for w in windows if w.window == 0}
    for w in several:
        head = firsts[w.conv_id]
        if head.startswith("<|im_start|>system\n"):
            assert w.formatted.startswith(head[:head.index(chat_format.END)])
        assert w.formatted[:w.new_start].count(chat_format.START) <= 3


def test_chat_empty(spark):
    none = spark.createDataFrame([], TURNS)
    assert chat_format.conversation_digests(chat_format.format_windows(none)).count() == 0


def got_hits(docs, bench, **kw):
    return brute.class_sort((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(docs, bench, **kw).collect())


def bench_rows():
    long = " ".join(f"alpha{i} beta gamma{i % 7}" for i in range(20, 40))
    return [(1, "A line that several documents share."), (2, "one"), (3, None), (4, "..."), (5, long), (5, long), (None, "short"),
            (6, "naïve café"), (7, "own line of the null row"), (8, "word7 über7 word8 über8 word9 über9 word10 über10 word11 über11 word12")]


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_decontamination_edge_cases(spark, edge, limit):
    bench = spark.createDataFrame(bench_rows(), "item_id long, text string").withColumn("words", F.lit("x"))
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    assert got_hits(edge, bench, broadcast_tokens=limit) == brute.class_sort(brute.contamination(rows, bench_rows()))
    clean = decontaminate.clean_documents(edge, bench)
    dirty = {d for d, _, hit, _ in brute.contamination(rows, bench_rows()) if hit}
    assert clean.columns == edge.columns
    assert brute.class_sort((r.doc_id, r.text) for r in clean.collect()) == brute.class_sort(x for x in rows if x[0] not in dirty)


def test_decontamination_random_overlaps(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9)))) for i in range(40)]
    got = got_hits(spark.createDataFrame(docs, "doc_id long, text string"),
                   spark.createDataFrame(items, "item_id long, text string"), window=4)
    assert got == brute.class_sort(brute.contamination(docs, items, 4))


def test_decontamination_empty_sides(spark, edge, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(edge, none).filter("contaminated").count() == 0
    assert decontaminate.contamination(empty, spark.createDataFrame(bench_rows(), "item_id long, text string")).count() == 0


@pytest.fixture(scope="module")
def tiktoken_coder():
    import public_tokenizers
    import tiktoken
    own = byte_bpe.bpe(None, None)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_bpe_edge_cases(edge, tiktoken_coder):
    got = byte_bpe.decode(byte_bpe.encode(edge.select("doc_id", "text", "score"))).join(
        edge.select(F.col("doc_id").alias("d"), "text"), F.col("doc_id").eqNullSafe(F.col("d"))).collect()
    want = {(r.doc_id, r.text): tiktoken_coder[1].encode_ordinary(r.text or "") for r in edge.collect()}
    assert {tuple(r.ids) for r in got} == {tuple(v) for v in want.values()}
    encoded = byte_bpe.encode(edge).collect()
    assert len(encoded) == edge.count()
    assert brute.class_sort((r.doc_id, tuple(r.ids)) for r in encoded) == brute.class_sort(
        (r.doc_id, tuple(tiktoken_coder[1].encode_ordinary(r.text or ""))) for r in edge.collect())


def test_bpe_empty(empty):
    assert byte_bpe.decode(byte_bpe.encode(empty)).count() == 0


PIECES = st.sampled_from(["a", "the ", " Tion", "'s", "'ll", " ", "\n", "\t", "\x1c", "\xa0", "　", "é", "ción", "漢", "😀", "½", "7", "42",
                          "!!", "<|endoftext|>", "\r\n", "ß", "\x85", "aaaaaaaa", "́"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=30).map("".join), min_size=1, max_size=4))
def test_bpe_equals_tiktoken(texts):
    import public_tokenizers
    import tiktoken
    own = byte_bpe.bpe(None, None)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    ids, at = own.encode(texts)
    for i, t in enumerate(texts):
        mine = ids[at[i]:at[i + 1]].tolist()
        assert mine == other.encode_ordinary(t)
        assert own.decode(mine) == t.encode()


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=2, max_size=300))
def test_both_segment_trees_agree(match):
    own = byte_bpe.bpe(None, None)
    width = 1 << (len(match) - 1).bit_length()
    ids, counts = own.merge_rows([match, match[:2]], width)
    assert ids[:counts[0]].tolist() == own.merge_one(match) and ids[counts[0]:].tolist() == own.merge_one(match[:2])


def test_one_pass_equals_encode_and_decode(spark, edge):
    both = byte_bpe.decode(byte_bpe.encode(edge)).collect()
    once = byte_bpe.round_trip(edge).collect()
    assert sorted(map(str, once)) == sorted(map(str, both))
    assert byte_bpe.round_trip(edge.limit(0)).collect() == []


@pytest.mark.parametrize("pattern", [r"\p{L}+ ?", r"\S+\s*|\s+", r" ?\p{L}+ ?| +"])
def test_other_patterns_may_match_over_a_space(pattern):
    import regex
    import tiktoken
    coder = byte_bpe.ByteBPE(byte_bpe.default_path(), pattern)
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=coder.ranks, special_tokens={})
    for text in ("hello big world", "a  b c", "naïve café  au lait"):
        ids, _ = coder.encode([text])
        assert ids.tolist() == reference.encode_ordinary(text)
        assert coder.decode(ids.tolist()).decode() == "".join(regex.findall(pattern, text))
