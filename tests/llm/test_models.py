from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from plinth.llm import quality, toxicity


def accuracy(spark, found, sf_dir, label):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    held = found.where("held_out").join(labels, "doc_id")
    row = held.agg(F.avg((F.col("predicted") == F.col("y")).cast("double")).alias("a"), F.avg("y").alias("m"), F.count(F.lit(1)).alias("n")).first()
    return row.a, max(row.m, 1 - row.m), row.n


@pytest.mark.parametrize(("query", "label"), [(quality.op4_quality, "quality"), (toxicity.op5_toxicity, "toxic")])
def test_held_out_accuracy(spark, query, label):
    sf_dir = "/root/testdata/sf0.1"
    got = query(spark, sf_dir)
    share, guess, n = accuracy(spark, got, sf_dir, label)
    assert n > 300 and share > guess + 0.03


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_documents(spark, docs, texts, none, module):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)] + [(None, 1, 1), (3, None, None), (4, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    model = module.fit(spark, docs, labels)
    got = module.score(spark, docs, model).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 30}) == 1
    assert module.score(spark, none, model).count() == 0
    blank = module.fit(spark, docs, labels.limit(0))
    assert all(0 <= r.score <= 1 for r in module.score(spark, docs, blank).collect())


def test_labels_that_are_held_out_are_never_read(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    for module, column in ((quality, "quality"), (toxicity, "toxic")):
        from plinth.llm.common import crc32_mod

        held = crc32_mod("doc_id", module.MODULUS) == module.HELD_OUT
        other = labels.withColumn(column, F.when(held, 1 - F.col(column)).otherwise(F.col(column)))
        texts = pa.array(["on the er ing", "stre ble"])
        score = (lambda m: quality.margins(m, texts)) if module is quality else (lambda m: toxicity.sentence_scores(m, texts)[0])
        assert np.array_equal(score(module.fit(spark, docs, labels)), score(module.fit(spark, docs, other)))


def test_noisy_or_finds_the_sentence(spark):
    rng = np.random.default_rng(0)
    plain = ["er on the.", "ing was nd!", "of re ti?"]
    rows, labels = [], []
    for i in range(200):
        bad = int(i % 3 == 0)
        own = [plain[k] for k in rng.integers(0, 3, 4)]
        if bad:
            own.insert(int(rng.integers(0, 4)), "you utter Scoundrel, er.")
        rows.append((i, " ".join(own)))
        labels.append((i, bad))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(spark, docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    for r in toxicity.score(spark, docs, model).collect():
        if labels[r.doc_id][1]:
            assert r.score >= 0.5 and r.n_offending == 1
            parts = [x for x in rows[r.doc_id][1].replace("!", ".").replace("?", ".").split(". ")]
            assert "Scoundrel" in parts[r.worst_sentence]
        else:
            assert r.score < 0.5 and r.n_offending == 0


def test_sentences_are_told_apart():
    _, _, starts = toxicity.sentences(pa.array(["a b. c d! e", "", None, "x\ny", "one"]))
    assert np.diff(starts).tolist()[:3] == [3, 1, 1] and starts[-1] == len(np.unique(np.arange(starts[-1])))


def test_word_margin_is_the_average_of_its_features():
    rng = np.random.default_rng(4)
    model = quality.Model(rng.normal(size=quality.BUCKETS), 0.25)
    buckets, _ = quality.features(pa.array(["abcd"]))
    assert len(buckets) == 1 + 4 + 3  # the word, <ab abc bcd cd>, <abc abcd bcd>
    assert quality.margins(model, pa.array(["abcd", ""])) == pytest.approx([model.value[buckets].mean() + 0.25, 0.25])
    same = int(mixed_int(0)) % quality.BUCKETS  # pairs of equal words share the bucket of no difference
    twice = [*buckets, *buckets, same]
    assert quality.margins(model, pa.array(["x", "abcd abcd"]))[1] == pytest.approx(model.value[twice].mean() + 0.25)


# --- plain versions ---

WORDS = re.compile("[^ \\t-\\r]+")
M64 = (1 << 64) - 1


def mixed_int(x: int) -> int:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> shift)) * factor & M64 if factor > 1 else x ^ (x >> shift)
    return x


def plain_features(text: str) -> Counter:
    found, before = Counter(), None
    for word in WORDS.findall(text):
        raw = xxhash.xxh3_64_intdigest(word.encode())
        found[mixed_int(raw) % quality.BUCKETS] += 1
        framed = f"<{word}>".encode()
        for size in quality.GRAMS:
            for i in range(len(framed) - size + 1):
                code = size
                for x in framed[i : i + size]:
                    code = (code * 257 + x + 1) & M64
                found[mixed_int(code) % quality.BUCKETS] += 1
        if before is not None:
            found[mixed_int((raw - before) & M64) % quality.BUCKETS] += 1
        before = raw
    return found


def small_corpus(spark, tmp_path):
    rng = random.Random(11)
    words = "er on the was stre ble nd ouer of thné hat".split()
    rows, labels = [(1000, None), (1001, ""), (1002, " \n\t"), (None, "er on the"), (1003, "x" * 30_000), (5, "er on the")], []
    for i in range(240):
        bad = i % 3 == 0
        own = [rng.choice(words) + rng.choice(["", ".", "!"]) for _ in range(rng.randint(1, 60))]
        if bad:
            own = [w + "$$$" for w in own] if i % 2 else [x for w in own for x in (w, w)]
            own.insert(rng.randrange(len(own)), "scoundrel")
        rows.append((i, rng.choice([" ", "\n", "  "]).join(own)))
        labels.append((i, int(not bad), int(bad)))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows, labels


def crc(i, modulus):
    return zlib.crc32(("" if i is None else str(i)).encode()) % modulus


def sigmoid(z):
    return 1 / (1 + math.exp(-min(30, max(-30, z))))


def test_quality_like_a_plain_version(spark, tmp_path):
    rows, labels = small_corpus(spark, tmp_path)
    y_of = {i: q for i, q, _ in labels if crc(i, 3) != 1}
    packed = []
    for i, text in rows:
        if i in y_of:
            found = sorted(plain_features(text or "").items())
            at = np.array([b for b, _ in found], dtype=np.uint16)
            share = np.array([n / max(1, sum(n for _, n in found)) for _, n in found], dtype=np.float16)
            packed.append((i, at.tobytes(), share.tobytes(), at, share.astype(np.float32)))
    packed.sort(key=lambda r: r[:3])
    model = quality.train([(at, share) for *_, at, share in packed], np.array([y_of[r[0]] for r in packed]))
    want = []
    for i, text in rows:
        found = plain_features(text or "")
        want.append((str(i), crc(i, 3) == 1, sigmoid(sum(n * model.value[b] for b, n in found.items()) / max(1, sum(found.values())) + model.bias)))
    got = sorted((str(r.doc_id), r.held_out, r.score) for r in quality.op4_quality(spark, str(tmp_path)).collect())
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-9)
    held = {str(i): q for i, q, _ in labels if crc(i, 3) == 1}
    assert sum((s >= 0.5) == held[i] for i, _, s in got if i in held) > 0.9 * len(held)


def plain_sentences(text: str) -> list[set[int]]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    marks = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + toxicity.BREAK
    out = [set()]
    for k, line in enumerate(low.split("\n")):
        tokens = WORDS.findall(line)
        for j, word in enumerate(tokens):
            plain = word.strip(marks)
            forms = [plain, *(plain[:n] for n in toxicity.PREFIXES)]
            says = [bool(plain), *(len(plain) > n for n in toxicity.PREFIXES)]
            out[-1] |= {mixed_int(xxhash.xxh3_64_intdigest(x.encode(), seed)) % toxicity.BUCKETS for seed, (x, on) in enumerate(zip(forms, says, strict=True)) if on}
            if re.search("[.!?][\"')\\]]*$", word):
                out.append(set())
        out.append(set())
    return out


def test_toxicity_like_a_plain_version(spark, tmp_path):
    """Empty sentences between ends differ in number only, so the bias is all they add; compare what says something, and the ends of the query's scores."""
    rows, labels = small_corpus(spark, tmp_path)
    y_of = {i: t for i, _, t in labels if crc(i, 5) != 0}
    model = toxicity.fit(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    for i, text in rows:
        sentence, feature, starts = toxicity.sentences(pa.array([text], pa.string()))
        mine = [set(feature[sentence == k].tolist()) for k in range(int(starts[-1]))]
        assert [x for x in mine if x] == [x for x in plain_sentences(text or "") if x], i
    got = toxicity.op5_toxicity(spark, str(tmp_path)).collect()
    plain = {}
    for i, text in rows:
        sets = plain_sentences(text or "")
        p = [sigmoid(sum(model.weights[f] for f in x) + model.bias) for x in sets if x]
        plain.setdefault(str(i), []).append((p, toxicity.sentences(pa.array([text], pa.string()))[2][-1] - len(p)))
    want = []
    for i, each in plain.items():
        for p, empty in each:
            clean = math.prod(1 - x for x in p) * (1 - sigmoid(model.bias)) ** int(empty)
            want.append((i, crc(None if i == "None" else int(i), 5) == 0, 1 - clean))
    rows_got = sorted((str(r.doc_id), r.held_out, r.score) for r in got)
    for a, b in zip(rows_got, sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-9)
    held = {str(i): t for i, _, t in labels if i not in y_of}
    assert sum((s >= 0.5) == held[i] for i, _, s in rows_got if i in held) > 0.9 * len(held)


def test_quality_steps_follow_the_gradient():
    rng = np.random.default_rng(1)
    vectors, out, bias = rng.normal(size=(20, 4)), rng.normal(size=(2, 4)), rng.normal(size=2)
    buckets, share, y, rate = np.array([2, 5, 11]), np.array([0.5, 0.2, 0.3]), 1, 1e-3

    def loss(v, o, b):
        z = o @ (share @ v[buckets]) + b
        return float(np.log(np.exp(z).sum()) - z[y])

    def slope(at, name):
        values = {"v": vectors, "o": out, "b": bias}
        found = []
        for d in (1e-6, -1e-6):
            moved = {k: x.copy() for k, x in values.items()}
            moved[name][at] += d
            found.append(loss(moved["v"], moved["o"], moved["b"]))
        return (found[0] - found[1]) / 2e-6

    v, o, b = vectors.copy(), out.copy(), bias.copy()
    quality.step(v, o, b, buckets, share, y, rate)
    for at in np.ndindex(out.shape):
        assert (o - out)[at] == pytest.approx(-rate * slope(at, "o"), rel=1e-4, abs=1e-12)
    for at in np.ndindex(bias.shape):
        assert (b - bias)[at] == pytest.approx(-0.1 * rate * slope(at, "b"), rel=1e-4, abs=1e-12)
    for at in np.ndindex(vectors.shape):
        assert (v - vectors)[at] == pytest.approx(-rate * 3 * slope(at, "v"), rel=1e-4, abs=1e-12)


def test_toxicity_slope_is_the_gradient():
    rng = np.random.default_rng(2)
    doc_of = np.array([0, 0, 1, 2, 2, 2, 3])
    row, col, y = rng.integers(0, 7, 25), rng.integers(0, 6, 25), np.array([1, 0, 1, 0])
    w = rng.normal(size=7)
    _, g = toxicity.loss_and_slope(w, row, col, doc_of, y)
    for k in range(7):
        d = np.zeros(7)
        d[k] = 1e-6
        assert g[k] == pytest.approx((toxicity.loss_and_slope(w + d, row, col, doc_of, y)[0] - toxicity.loss_and_slope(w - d, row, col, doc_of, y)[0]) / 2e-6, rel=1e-5, abs=1e-9)
