from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.llm import common, exact_dedup, line_dedup, near_dedup
from plinth.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- lines ---


def plain_lines(texts):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = defaultdict(list)
    for i, t in texts:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                holders[k].append(i)
    last = {k: max((x for x in v if x is not None), default=None) for k, v in holders.items() if len(v) >= 3}
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if (k := key(x)) not in last or last[k] is None or last[k] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("keys", "bits", "broadcast"), [(1 << 18, 1 << 22, 1 << 21), (8, 1 << 8, 1 << 21), (8, 4, 0), (1 << 18, 1 << 22, 0)])
def test_lines(spark, docs, texts, monkeypatch, keys, bits, broadcast):
    """One range and many, filters with room and full ones, suspects broadcast and joined."""
    monkeypatch.setattr(line_dedup, "RANGE_KEYS", keys)
    monkeypatch.setattr(line_dedup, "RANGE_BITS", bits)
    monkeypatch.setattr(line_dedup, "BROADCAST_HASHES", broadcast)
    got = line_dedup.dedup_lines(spark, docs)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    want = plain_lines(texts)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert any(x[2] for x in want)


def test_few_lines_are_suspected(spark):
    """A line in two documents stays unsuspected; one in three is found however the tasks cut the documents."""
    rows = [(i, f"this is the own line number {i} of it\nthis line is shared by the pair {i // 2}\nthis line is shared by four, which are {i // 4}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    scratch = common.Scratch(spark, "test")
    found = {r.hash for r in line_dedup.suspected(scratch, docs).collect()}
    holders = defaultdict(set)
    for i, t in rows:
        for x in t.split("\n"):
            holders[x].add(i)
    hashes = dict(zip(holders, line_dedup.string_hashes(line_dedup.pa.array(list(holders))).view(np.int64).tolist(), strict=True))
    often = {hashes[x] for x, v in holders.items() if len(v) >= 3}
    assert often and often <= found and len(found - often) <= len(holders) // 100


def test_lines_with_text(spark, docs):
    for r in line_dedup.dedup_lines(spark, docs, with_text=True).collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_no_lines(spark, none):
    assert line_dedup.dedup_lines(spark, none).count() == 0


# --- exact copies ---


def plain_copies(texts):
    groups = defaultdict(list)
    clean = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for i, t in texts:
        groups[clean(t)].append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t in texts:
        own = groups[clean(t)]
        best = min(own)
        out.append((i, None if best[1] else best[2], len(own), hashlib.sha256(clean(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("history", [None, "nothing", "everything"])
def test_copies(spark, docs, texts, history):
    is_history = {None: None, "nothing": F.lit(False), "everything": F.lit(True)}[history]
    got = exact_dedup.exact_dedup(spark, docs, is_history).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain_copies(texts)
    kept = [r.text_sha256 for r in got if r.kept]
    assert sorted(kept) == sorted({r.text_sha256 for r in got})  # one row of each group stays, repeated rows included
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("history", [False, True])
def test_buckets_are_bounded_without_history(spark, monkeypatch, history):
    """New digests alone are dealt to as many buckets as digests of history are."""
    monkeypatch.setattr(exact_dedup, "BUCKET_KEYS", 16)
    seen = []
    plain = exact_dedup.look_up
    monkeypatch.setattr(exact_dedup, "look_up", lambda fresh, index, n: seen.append((fresh, n)) or plain(fresh, index, n))
    docs = spark.range(800).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 400).alias("text"))
    got = exact_dedup.exact_dedup(spark, docs, F.lit(history)).collect()
    assert len(got) == 800 and {r.group_size for r in got} == {2} and sum(r.kept for r in got) == 400
    [(fresh, n)] = seen
    assert n == 25
    if not history:
        sizes = [r["count"] for r in fresh.groupBy(exact_dedup.bucket_of(F.col("digest"), n)).count().collect()]
        assert sum(sizes) == 400 and max(sizes) < 40


def test_no_copies(spark, none):
    assert exact_dedup.exact_dedup(spark, none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500, 5000])
def test_slots_are_a_bijection(n):
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)
    shifts, slots = exact_dedup.build_slots(keys)
    assert sorted(slots.tolist()) == list(range(n))
    if n:
        assert (exact_dedup.find_slots(keys, shifts, n) == slots).all()
        strangers = np.frombuffer(b"".join(hashlib.sha256(f"x{i}".encode()).digest() for i in range(50)), np.uint8).reshape(-1, 32)
        at = exact_dedup.find_slots(strangers, shifts, n)
        by_slot = keys[np.argsort(slots)]
        assert not (by_slot[at] == strangers).all(axis=1).any()  # the bytes tell them apart


# --- near copies ---


def plain_near(texts):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(texts):
        if doc is not None:
            ids[find(i)].append(doc)
    out = []
    for i, (doc, _) in enumerate(texts):
        best = min(ids[find(i)], default=None) if sets[i] else doc
        out.append((doc, len(sets[i]), best, doc == best))
    return sorted(out, key=str)


def test_near(spark, docs, texts):
    got = near_dedup.near_dedup(spark, docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == plain_near(texts)
    assert len([r for r in got if r.first_row]) == len({r.component_id if r.n_shingles else (r.doc_id, n) for n, r in enumerate(got)})


def test_no_near(spark, none):
    assert near_dedup.near_dedup(spark, none).count() == 0


def test_chains_beyond_the_first_star(spark):
    """Each text is linked with its neighbours alone, so the star around the least one is not enough."""
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - k, " ".join(words[8 * k : 8 * k + 100])) for k in range(25)]
    got = near_dedup.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=str) == plain_near(rows)


@pytest.mark.parametrize("large", [8, 24, 4096])
def test_cells_with_several_blocks(spark, monkeypatch, large):
    import random

    rng = random.Random(5)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "MARK_BLOCK", large)
    got = near_dedup.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=str) == plain_near(rows)


@pytest.mark.parametrize(("block", "large"), [(4, 4), (4, 16), (512, 4096)])
def test_each_pair_of_one_bucket_is_compared(spark, monkeypatch, block, large):
    """One bucket with 120 nodes, in which each has one partner alone, and similar texts without a link."""
    text = lambda k, last: " ".join([f"c{i}" for i in range(75)] + [f"p{k}_{i}" for i in range(24)] + [last])
    docs = spark.createDataFrame([(2 * k + j, text(k, f"e{j}")) for k in range(60) for j in range(2)], "doc_id long, text string").withColumn("row_id", F.col("doc_id"))
    same = F.array(*[F.lit(b).cast("bigint") for b in range(near_dedup.BANDS)])
    nodes = near_dedup.sketch(docs).select(F.col("doc_id").alias("node"), "key", "signature", same.alias("bands"), "n_shingles").cache()
    members = nodes.select(F.lit(0).cast("bigint").alias("band"), "node")
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "MARK_BLOCK", large)
    roots = spark.createDataFrame([(2, 0), (0, 0), (7, 5), (5, 5)], "node long, root long")
    got = near_dedup._rest(near_dedup.Scratch(spark, "test"), docs, members, roots, nodes)
    assert sorted((r.a, r.b) for r in got.collect()) == [(2 * k, 2 * k + 1) for k in range(60)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50 + i) for i in range(1, 30)] + [(7, 7)]
    found = {r.node: r.root for r in components(common.Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{50 + i: 51 for i in range(2, 30)}, 100: 51}
    assert components(common.Scratch(spark, "test"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_bands_find_similar_pairs():
    """Sets with a similarity of about 0.76 share a band nearly always."""
    rng = np.random.default_rng(1)
    a, b = near_dedup._constants()
    room = np.empty((near_dedup.HASHES, 1024), np.uint32)
    missed = 0
    for _ in range(300):
        x = rng.integers(0, 2**63, 200, dtype=np.uint64)
        y = np.concatenate([x[:173], rng.integers(0, 2**63, 27, dtype=np.uint64)])
        k = [near_dedup.band_keys(near_dedup.minima(s, a, b, room)) for s in (x, y)]
        missed += not (k[0] == k[1]).any()
    assert missed == 0


def test_links_at_the_border_are_found(spark):
    """End to end, bands and signatures together, on texts whose similarity is 0.75 to 0.80."""
    import random

    rng = random.Random(8)
    rows, pairs = [], []
    for i in range(400):
        n = rng.choice([60, 120, 300])
        words = [f"w{i}x{k}" for k in range(n + 4)]  # n shingles, all of their own
        # every changed word at the end takes off one shingle and adds another: (n - c) / (n + c)
        c = next(c for c in range(n) if (n - c - 1) / (n + c + 1) < rng.uniform(0.75, 0.79))
        while 100 * (n - c) < 75 * (n + c):
            c -= 1
        other = words[: n + 4 - c] + [f"v{i}x{k}" for k in range(c)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        pairs.append((n - c) / (n + c))
    assert 0.75 <= min(pairs) and max(pairs) <= 0.81
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[2 * i + 1] == 2 * i for i in range(400))
    assert found >= 398, found
