from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plinth.llm import chat, decontaminate, lm_scoring, sentencepiece_coding, sharding
from plinth.llm.lattice import UNITS, arcs_from, load_vocabulary, prepare
from plinth.llm.sentencepiece_coding import Encoder, best_and_loss, decode, n_best, segment, units_of

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- chat ---


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\<|>s/[INST] x", max_size=30))
def test_escape_is_reversible(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(mark in safe for mark in chat.CONTROL)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a|", "<", ""]), st.text(alphabet="<|>/s\\\n a", max_size=12)), min_size=1, max_size=12))
def test_spans_cover_the_whole_text(messages):
    spans = chat.Spans(chat.TURNS, [])
    found = [spans.add(m) for m in messages]
    assert "".join(found) == chat.TURNS.render(messages) and not spans.rewrites
    for (role, text), span in zip(messages, found, strict=True):
        read, a, b = chat.TURNS.read(span)
        assert (read, chat.unescape(span[a:b])) == (role, text)


def test_rewritten_history_is_found(spark):
    def render(messages):  # only the last answer is shown in full
        return "".join(f"<|{r}|>\n{t if i == len(messages) - 1 or r == 'user' else t[:2]}</s>\n" for i, (r, t) in enumerate(messages))

    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "long answer"), (1, 2, "user", "again"), (1, 3, "assistant", "short"), (2, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.history_rewrites for r in chat.conversation_digests(rows, chat.Template(render, chat._read_turn)).collect()}
    assert got == {1: 1, 2: 0}
    with pytest.raises(Exception, match="looks back further"):
        chat.conversation_digests(rows, chat.Template(render, chat._read_turn, lookback=0)).collect()


@pytest.mark.parametrize("turns", [9, 20, 33])
def test_a_template_that_looks_back_late_is_found(spark, turns, monkeypatch):
    """From turn 9 on an older answer is cut; the stated lookback hides that from the windows, not from the prefixes."""

    def render(messages):
        return "".join(f"<|{r}|>\n{t if len(messages) < 9 or i >= len(messages) - 2 else t[:2]}</s>\n" for i, (r, t) in enumerate(messages))

    late = chat.Template(render, chat._read_turn, lookback=1)
    rows = [(1, i, "assistant" if i % 2 else "user", f"text {i}") for i in range(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="looks back further"):
        chat.conversation_digests(df, late).collect()
    with pytest.raises(Exception, match="looks back further"):
        chat.format_turns(df, late).collect()
    good = [r.asDict() for r in chat.conversation_digests(df).collect()]
    monkeypatch.setattr(chat, "STRETCH", 60)  # several prefixes
    spans = chat.Spans(chat.TURNS, [])
    for _, _, role, text in rows:
        spans.add((role, text))
    spans.finish()
    assert len(spans.before) < 9 and good[0]["n_turns"] == turns and good[0]["history_rewrites"] == 0


def test_conversations(spark):
    rows = [(1, 0, "user", "hi <|x|>"), (1, 1, "assistant", "a</s>b\\"), (1, 1, "assistant", None), (2, None, None, None), (None, 0, "assistant", "é" * 3000), (3, 5, "system", ""), *((9, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(60))]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, span long, position string").repartition(3)
    got = {r.conv_id: r for r in chat.conversation_digests(df).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in order if r[0] == conv]
        answers = "".join(t for r, t in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars, r.history_rewrites) == (len(own), len(answers), 0)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(answers.encode()).hexdigest()
        assert r.formatted_chars == len(chat.TURNS.render(own))
    turns = chat.format_turns(df).where("conv_id = 1").orderBy("position").collect()
    assert "".join(t.span for t in turns) == chat.TURNS.render([(r[2] or "", r[3] or "") for r in order if r[0] == 1])
    assert chat.conversation_digests(df.limit(0)).count() == 0


# --- pieces ---


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary(sentencepiece_coding.VOCABULARY)


def all_paths(unit, v):
    found = []

    def go(at, score, ids):
        if at == len(unit):
            found.append((score, tuple(ids)))
            return
        for stop, x in arcs_from(unit, at, v):
            go(stop, score + sum(v.scores[i] for i in x), ids + list(x))

    go(0, 0.0, [])
    return sorted(found, key=lambda x: -x[0])


UNITS_TRIED = [" hello", "   the", " thnthat", "é", " 日本x", "\n", " aaaaaaa", " ▁x", " ", "\x00", " ﬁn"]


@pytest.mark.parametrize("unit", UNITS_TRIED)
def test_n_best_of_a_unit(vocabulary, unit):
    paths = all_paths(unit, vocabulary)
    found = n_best(unit, vocabulary, 7)
    assert [s for s, _ in found] == [s for s, _ in paths[:7]] and len({p for _, p in found}) == len(found)
    assert all((s, p) in paths for s, p in found)
    ids, score, loss = best_and_loss(unit, vocabulary)
    assert (ids, score) == (found[0][1], paths[0][0]) and loss == (paths[0][0] - paths[1][0] if len(paths) > 1 else math.inf)


def test_segment_like_one_by_one(vocabulary):
    units = UNITS_TRIED + [" " + "er" * 30, "x" * 500]
    flat, counts, score, loss = segment(units, vocabulary.index(), vocabulary)
    at = np.concatenate([[0], np.cumsum(counts)])
    for i, unit in enumerate(units):
        assert (tuple(flat[at[i] : at[i + 1]].tolist()), score[i], loss[i]) == best_and_loss(unit, vocabulary)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="the cat\n▁é日 ", max_size=25))
def test_whole_texts(text):
    v = _shared()
    assert units_of(pa.array([text]))[0].to_pylist() == UNITS.findall(prepare(text))
    coder = Encoder(v, 4)
    ((ids, scores, _),) = coder.encode(pa.array([text]))
    assert decode(ids, v).decode() == text
    ways = [all_paths(u, v)[:4] for u in UNITS.findall(prepare(text))]
    best = [0.0]
    for w in ways:
        best = sorted((a + s for a in best for s, _ in w), reverse=True)[:4]
    assert scores == best
    for (score, path), want in zip(coder.alternatives(text), scores, strict=True):
        assert score == want and decode(path, v).decode() == text


_held = []


def _shared():
    if not _held:
        _held.append(load_vocabulary(sentencepiece_coding.VOCABULARY))
    return _held[0]


def test_encoding(spark, docs, texts, none):
    got = sentencepiece_coding.encode_documents(spark, docs).collect()
    assert len(got) == len(texts) and all(r.round_trip for r in got)
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in texts)
    for r in got:
        assert r.n_pieces == len(r.pieces) and r.best_score == r.scores[0] and r.scores == sorted(r.scores, reverse=True)
        assert r.pieces_sha256 == hashlib.sha256(np.array(r.pieces, "<i4").tobytes()).hexdigest()
    assert sentencepiece_coding.encode_documents(spark, none).count() == 0


# --- benchmark ---


def plain_hits(texts, items, size=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = {}
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - size + 1)) if w else []:
            windows.setdefault(tuple(w[i : i + size]), set()).update([] if item is None else [str(item)])
    sizes = {len(w) for w in windows}
    out = []
    for doc, t in texts:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i : i + n]))
                if own is not None:
                    hit.update(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [50_000, 0])  # broadcast and shuffled joins
def test_hits(spark, docs, texts, none, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
    base = [t for _, t in texts if t and len(t.split()) > 50]
    items = [(1, " ".join(base[0].split()[3:30])), (10, base[1]), (2, "one two"), (3, None), (4, ""), (5, "no such words anywhere"), (1, base[2]), (7, "thné! heß"), (None, " ".join(base[3].split()[:20])), (None, base[1])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, window long")
    got = decontaminate.decontaminate(spark, docs, bench).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in got), key=str) == plain_hits(texts, items)
    assert all(r.n_items == len(r["items"]) for r in got)
    assert decontaminate.decontaminate(spark, none, bench).count() == 0
    assert not any(r.n_hit for r in decontaminate.decontaminate(spark, docs, bench.limit(0)).collect())


def test_hits_in_plain_plans(spark, docs, texts):
    bench = spark.createDataFrame([(1, texts[0][1])], "item_id long, text string")
    plan = decontaminate.decontaminate(spark, docs, bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)


# --- shards ---


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, runs, fill = (low + high) // 2, 1, 0
        for s in sizes:
            if fill + s > mid:
                runs, fill = runs + 1, 0
            fill += s
        low, high = (low, mid) if runs <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize(("shards", "digits"), [(24, 4), (24, 1), (5, 1), (1, 4)])
def test_shards(spark, docs, texts, shards, digits, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_DIGITS", digits)
    got = sharding.shard(spark, docs, shards).collect()
    assert len(got) == len(texts)
    sizes = Counter()
    for _, t in texts:
        sizes[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + 8
    best = least_capacity([sizes[k] for k in sorted(sizes)], shards)
    load = Counter()
    for r in got:
        load[r.shard] += r["size"]
    assert max(load.values()) == best and max(load) < shards
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got if r.doc_id is not None) == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts if i is not None)
    for s in load:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len({(r.digest, r.shard) for r in got}) == len({r.digest for r in got})


def test_no_shards(spark, none):
    assert sharding.shard(spark, none).count() == 0


@pytest.mark.parametrize("largest", [50, 3000, 10**6])
def test_cuts_over_pieces_are_exact(largest):
    """Against a search that knows every group; no fetch asks for more than four pieces a shard, and no piece comes whole at once."""
    rng = np.random.default_rng(2)
    for n in (1, 2, 30, 700, 5000):
        for shards in (1, 3, 7, 24):
            names = sorted({f"{x:08x}" for x in rng.integers(0, 2**32, n).tolist()})
            sizes = dict(zip(names, rng.integers(1, largest, len(names)).tolist(), strict=True))
            sizes[names[len(names) // 2]] += 3 * largest

            def pieces(digits, among=None, sizes=sizes):
                groups: dict[str, list] = {}
                for k, v in sizes.items():
                    if among is None or any(k.startswith(x) for x in among):
                        groups.setdefault(k[:digits], []).append((k, v))
                return [(p, sum(v for _, v in g), max(v for _, v in g), max(k for k, _ in g), len(g)) for p, g in groups.items()]

            asked = []

            def fetch(some, asked=asked, pieces=pieces):
                asked.append(len(some))
                return [r for d in {len(x) for x in some} for r in pieces(d + 2, [x for x in some if len(x) == d])]

            cuts = sharding.cut_digests(sharding.Pieces.of(pieces(2)), shards, fetch)
            assert len(cuts) < shards and max(asked, default=0) <= 4 * shards
            load = Counter()
            for k in names:
                load[sum(k > c for c in cuts)] += sizes[k]
            assert max(load.values()) == least_capacity([sizes[k] for k in names], shards)


# --- scores ---


def test_scores(spark, texts, none):
    short = [(i, t) for i, t in texts if t is None or len(t) < 2000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in short], "doc_id long, text string, row_id long").repartition(3)
    got = lm_scoring.score_documents(spark, docs).collect()
    toks = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), None]
    c = Counter()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    for i, t in short:
        if not held(i):
            c.update(toks(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t)), 6)) for i, t in short)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    same = [r.score for r in got if r.doc_id == 30]
    assert len(same) == 2 and same[0] == pytest.approx(same[1])
    assert lm_scoring.score_documents(spark, none.select("doc_id", "text")).count() == 0


def test_score_is_the_marginal_over_all_segmentations(spark, monkeypatch):
    """The very scores that the query returns, with all words in the head or all in the tail, against sums over all paths."""
    rows = [(i, t) for i, t in enumerate(["on the", "the er on", "onthe", "er er the", "zq", "the on er", "on on", "", "\u4e9a er"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for head in (1 << 17, 0):
        monkeypatch.setattr(lm_scoring, "HEAD", head)
        found.append({r.doc_id: (r.score, r.word_score) for r in lm_scoring.score_documents(spark, docs).collect()})
    assert all(found[0][i] == pytest.approx(found[1][i]) for i in found[0])
    v = _shared()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in t.split())
    ends = sum(not held(i) for i, _ in rows)
    used = np.zeros(len(v.scores), dtype=bool)
    used[[*v.ids.values(), *v.byte_ids]] = True

    def paths(unit, w):
        out = []

        def go(at, p, ids):
            if at == len(unit):
                out.append((p, ids))
                return
            for stop, x in arcs_from(unit, at, v):
                go(stop, p * math.prod(w[i] for i in x), ids + list(x))

        go(0, 1.0, [])
        return out

    weights = lm_scoring.first_weights(v)
    for turn in range(lm_scoring.EM_ROUNDS):
        share = weights / (weights.sum() + (ends if turn else 0))
        counts = np.full(len(weights), lm_scoring.SMOOTHING)
        for word, k in c.items():
            every = paths(" " + word, share)
            mass = sum(p for p, _ in every)
            for p, ids in every:
                for i in ids:
                    counts[i] += k * p / mass
        weights = np.where(used, counts, 1e-300)
    all_mass = weights.sum() + ends + lm_scoring.SMOOTHING
    share = weights / all_mass
    n = sum(c.values()) + ends
    tally = Counter([*c.values(), ends])
    d = tally[1] / (tally[1] + 2 * tally[2]) if tally[1] and tally[2] else 0.5
    for i, t in rows:
        by_piece, by_word = math.log10((ends + lm_scoring.SMOOTHING) / all_mass), math.log10(ends / n)
        for word in t.split():
            marginal = sum(p for p, _ in paths(" " + word, share))
            by_piece += math.log10(marginal)
            by_word += math.log10((max(0.0, c[word] - d) / n if c[word] else 0.0) + d * len(c) / n * marginal)
        assert found[0][i] == pytest.approx((by_piece, by_word), rel=1e-9)


def test_training_makes_the_vocabulary_fit(spark, sf01):
    """Held-out texts are likelier than under the weights that the vocabulary's scores start with."""
    held = spark.read.parquet(f"{sf01}/documents.parquet")
    fitted = lm_scoring.score_documents(spark, held).where("held_out").agg(F.sum("score")).first()[0]
    untrained = lm_scoring.pieces(_shared(), lm_scoring.first_weights(_shared()), 1.0)
    texts = [r.text for r in held.where(lm_scoring.crc32_mod("doc_id", 7) == 2).collect()]
    words = Counter(w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)))
    plain = lm_scoring.marginals([" " + w for w in words], untrained) @ np.array(list(words.values())) / math.log(10)
    assert fitted > 0.9 * plain > plain


def test_pieces_of_equal_hash_are_told_apart(monkeypatch):
    index = _shared().index()
    chars = np.array([[ord(x) for x in "the"]], dtype=np.uint32)
    slot = int(lm_scoring.arc_slots(chars, index)[0, 0, 0])
    assert index.ids[slot] == _shared().ids["t"]
    last = index.last.copy()
    monkeypatch.setattr(index, "last", np.where(np.arange(len(last)) == slot, ord("z"), last))  # as if the string in the slot were another
    assert lm_scoring.arc_slots(chars, index)[0, 0, 0] == -1
