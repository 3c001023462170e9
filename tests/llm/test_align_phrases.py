"""SimHash groups, cross-tokenizer alignment and phrase mining against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from storefront.llm import align, phrases, simhash
from storefront.llm.double_array import DoubleArray


# simhash -------------------------------------------------------------------------
def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(fps):
    """Least index reachable over links, by comparing all pairs."""
    top = list(range(len(fps)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 2:
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def simhash_rows(rows):
    """(doc_id, fingerprint, component id) of every row."""
    fps = [brute_fingerprint(t) for _, t in rows]
    groups = brute_groups(fps)
    least = {}
    for (d, _), g in zip(rows, groups):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return sorted(((d, f, least.get(g)) for (d, _), f, g in zip(rows, fps, groups)), key=str)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_simhash_of_edge_rows(edge):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.simhash_groups(edge).collect()]
    assert sorted(got, key=str) == simhash_rows(rows)


def test_simhash_query_equals_brute_force(spark, sf001, docs001):
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.op11_simhash(spark, sf001).collect()]
    assert all(len(r.fingerprint) == 16 for r in simhash.op11_simhash(spark, sf001).limit(5).collect())
    assert sorted(got, key=str) == simhash_rows([(r.doc_id, r.text) for r in docs001.collect()])


def test_simhash_of_nothing(empty):
    assert simhash.simhash_groups(empty).collect() == []


def test_long_text_is_hashed_in_blocks(monkeypatch):
    text = " ".join(f"w{i * i % 991}" for i in range(1000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text.encode()) == whole == brute_fingerprint(text)


def test_close_links_join_every_near_pair(spark):
    """Clouds of fingerprints around common origins: the components are those of all pairs."""
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1, 1, 3, 7}
    for _ in range(12):
        origin = rng.getrandbits(64)
        for _ in range(25):
            x = origin
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    links = simhash.close_links(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()
    assert all((r.a % (1 << 64) ^ r.b % (1 << 64)).bit_count() in (1, 2) for r in links)
    top = {x: x for x in fps}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for r in links:
        x, y = find(r.a % (1 << 64)), find(r.b % (1 << 64))
        top[max(x, y)] = min(x, y)
    assert [find(x) for x in fps] == [fps[g] for g in brute_groups(fps)]


def test_a_cloud_of_copies_makes_rows_in_proportion(spark):
    """All fingerprints two bits from one origin: a fingerprint names 65 points at most, so it gets no more links."""
    fps = [signed(0x5A5A5A5A5A5A5A5A ^ (1 << i) ^ (1 << j)) for i in range(64) for j in range(i)]
    assert simhash.close_links(spark.createDataFrame([(x,) for x in fps], "fp long")).count() <= 64 * len(fps)


def test_segment_counts_bound_the_distance():
    rng = np.random.default_rng(3)
    x, y = (rng.integers(0, 1 << 64, 500, dtype=np.uint64) for _ in range(2))
    y[:250] = x[:250] ^ (np.uint64(1) << rng.integers(0, 64, 250).astype(np.uint64))
    counts = lambda v: np.stack([(simhash.segment_counts(v) >> np.uint64(4 * s)) & np.uint64(15) for s in range(16)], 1).astype(int)
    assert (counts(x).sum(1) == [int(v).bit_count() for v in x]).all()
    assert (np.abs(counts(x) - counts(y)).sum(1) <= [int(a ^ b).bit_count() for a, b in zip(x, y)]).all()


# alignment -----------------------------------------------------------------------
def brute_alignment(text):
    """(A ids, B ids, links, groups) token by token, None without tokens."""
    if not text:
        return None
    coder = align.aligner(None, None)
    a, b = coder.a.encode(" " + text, add_special_tokens=False).ids, coder.b.encode(text)
    letters = align._byte_letters()
    part_a = [bytes(letters[c] for c in coder.a.id_to_token(i)) for i in a]
    part_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
              for p in map(coder.b.id_to_piece, b)]
    want = b" " + text.encode()
    if b"".join(part_a) != want or b"".join(part_b) != want:
        return None

    def spans(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out
    sa, sb = spans(part_a), spans(part_b)
    links, j = [], 0
    for i, (x, y) in enumerate(sa):
        while sb[j][1] <= x:
            j += 1
        k = j
        while k < len(sb) and sb[k][0] < y:
            links.append((a[i], b[k]))
            k += 1
    groups, i, j = [], 0, 0
    for cut in sorted({y for _, y in sa} & {y for _, y in sb}):
        own_a, own_b = [], []
        while i < len(sa) and sa[i][1] <= cut:
            own_a.append(a[i])
            i += 1
        while j < len(sb) and sb[j][1] <= cut:
            own_b.append(b[j])
            j += 1
        groups.append((own_a, own_b))
    return a, b, links, groups


def brute_documents(rows):
    found = [brute_alignment(t) for _, t in rows]
    count = Counter(p for f in found if f for p in f[2])
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for (d, _), f in zip(rows, found):
        if f is None:
            out.append((d, 0, 0, 0, 0, 0, 0, "", 0))
            continue
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in f[3])
        out.append((d, len(f[0]), len(f[1]), len(f[3]), len(f[2]), sum(count[p] == top[p[1]] for p in f[2]),
                    sum(count[p] for p in f[2]), hashlib.sha256(text.encode()).hexdigest(), sum(len(x) * len(y) for x, y in f[3])))
    return sorted(out, key=str)


ODD = ["a▁b", "<0x41> <unk> <s> x</s>", "日本語 text with ひらがな", "tab\tand\r\nnew lines  two spaces", " leading", "trailing ",
       "\u0000nul", "emoji 👩‍👩‍👧 joined", "ﬁ ligature é", "x" * 5000]


@pytest.mark.parametrize("frequent", [align.FREQUENT_PAIRS, 7])
def test_alignment_of_edge_rows(spark, edge, frequent):
    """With few pairs broadcast, the others come back by the shuffle join."""
    rows = [(r.doc_id, r.text) for r in edge.collect()] + [(100 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(d, t, 5, "x") for d, t in rows], "doc_id long, text string, row int, pairs string").repartition(3)
    got = sorted((tuple(r) for r in align.align_documents(docs, frequent=frequent).collect()), key=str)
    assert got == brute_documents(rows)


def test_alignment_query_equals_brute_force(spark, sf001, docs001):
    got = align.op12_align(spark, sf001).collect()
    assert sorted(map(tuple, got), key=str) == brute_documents([(r.doc_id, r.text) for r in docs001.collect()])


def test_alignment_of_nothing(empty):
    assert align.align_documents(empty).collect() == []


def test_csr_products_equal_dense_ones():
    rng = np.random.default_rng(11)

    def sparse(dense):
        row, col = np.nonzero(dense)
        return align.CSR(np.concatenate([[0], np.cumsum((dense != 0).sum(1))]).astype(np.int64), col.astype(np.int64),
                         dense[row, col].astype(np.int64), dense.shape[1])

    def dense(m):
        out = np.zeros((m.rows, m.columns), np.int64)
        out[m.row_of(), m.indices] = m.values
        return out
    for rows, inner, cols in ((5, 7, 4), (1, 1, 1), (0, 3, 2), (6, 0, 3), (9, 9, 9)):
        x = rng.integers(0, 3, (rows, inner)) * rng.integers(0, 2, (rows, inner))
        y = rng.integers(0, 3, (inner, cols)) * rng.integers(0, 2, (inner, cols))
        sx, sy = sparse(x), sparse(y)
        assert (dense(align.product(sx, sy)) == x @ y).all()
        assert (dense(align.transpose(sx)) == x.T).all()
        assert (align.product_size(sx, sy) == ((x != 0).astype(int) @ (y != 0).astype(int)).sum(1)).all()


def test_group_links_come_from_the_incidence_product():
    coder = align.aligner(None, None)
    found = align.align(coder, ["unaffordable naïveté", None, "", "plain words"])
    links = found.group_links()
    assert (found.group_link_counts() == np.diff(links.indptr)).all()
    group_a, group_b = found.groups_a.indices, found.groups_b.indices
    assert sorted(zip(links.row_of(), links.indices)) == [(i, j) for i in range(len(group_a)) for j in range(len(group_b)) if group_a[i] == group_b[j]]


# phrases -------------------------------------------------------------------------
def brute_phrases(rows, least, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", (text or "").encode().lower()):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) >= 2 and a >= least}
        cover = Counter()
        for p, a in cands.items():
            for w in range(2, len(p)):
                for i in range(len(p) - w + 1):
                    cover[p[i:i + w]] = max(cover[p[i:i + w]], a)
        found = []
        for p, a in cands.items():
            if 100 * cover[p] >= 100 * a:
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, b" ".join(p), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def mined(docs, **how):
    return sorted(map(tuple, phrases.collocations(docs, **how).collect()))


def test_phrases_of_edge_rows(spark, edge):
    rows = [(r.text, r.lang) for r in edge.collect()]
    extra = [("one two three four five six. ONE TWO three; four,five\tsix" + "\x0bone two" * 3, None), ("one two three", "und"),
             ("a a a a a a a a", "en"), ("naïve café ! naïve café", "fr"), ("", "xx"), (None, None), ("\t \n.,", "yy")] * 3
    docs = spark.createDataFrame([(t, l, 1, "c") for t, l in rows + extra], "text string, lang string, count int, phrase string").repartition(3)
    for least in (2, 3):
        assert mined(docs, min_count=least) == brute_phrases(rows + extra, least)


def test_phrases_do_not_depend_on_trie_size_or_memory(docs001, monkeypatch):
    rows = [(r.text, r.lang) for r in docs001.collect()]
    want = brute_phrases(rows, 10, top=50)
    assert mined(docs001, min_count=10, top=50) == want
    assert mined(docs001, min_count=10, top=50, max_phrases=37) == want


def test_phrases_of_nothing(spark, empty):
    assert mined(empty) == []
    assert mined(spark.createDataFrame([(None, None), ("", "en"), ("too few words", "en")], "text string, lang string")) == []


def test_words_and_sums_held_in_a_task_are_handed_on(monkeypatch):
    monkeypatch.setattr(phrases, "PAIRS_HELD", 3)
    sums, keys = phrases._Sums(), np.array([5, 1, 5, 9, 2, 5, 7, 1])
    for i in range(0, 8, 2):
        sums.add(keys[i:i + 2])
    assert [x.tolist() for x in sums.merge()] == [[1, 2, 5, 7, 9], [2, 1, 3, 1, 1]]


def test_double_array_holds_exactly_its_phrases():
    rng = random.Random(2)
    rows = sorted({tuple(rng.randrange(40) for _ in range(rng.randint(1, 5))) for _ in range(800)})
    matrix = np.array([list(r) + [-1] * (5 - len(r)) for r in rows])
    trie = DoubleArray(matrix, 40)
    slots = trie.walk(matrix)
    assert (slots == trie.slots).all() and len(set(slots.tolist())) == len(rows) and trie.accepts[slots].all()
    assert trie.accepts.sum() == len(rows)
    known = set(rows)
    others = [tuple(rng.randrange(40) for _ in range(rng.randint(1, 5))) for _ in range(800)]
    found = trie.walk(np.array([list(r) + [-1] * (5 - len(r)) for r in others]))
    assert [bool(s >= 0 and trie.accepts[s]) for s in found] == [r in known for r in others]
    assert DoubleArray(np.zeros((0, 1), np.int64), 0).walk(np.array([[0], [-1]])).tolist() == [-1, 0]
