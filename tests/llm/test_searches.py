"""Long repeats, hard negatives and collocations against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwatch.llm import negatives, phrases, repeats
from driftwatch.llm.negatives import hard_negatives, integer_vectors, threshold_join
from driftwatch.llm.phrases import Shape, collocations, packed, permuted, unpacked
from driftwatch.llm.repeats import long_matches, without_repeats
from tests.llm.conftest import ODD


# long repeats

def kept_bytes(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, len(t), bytes(b for b, x in zip(t, gone, strict=True) if not x), spans))
    return sorted(out, key=repr)


def without(df, length):
    return sorted(((r.doc_id, r.n_bytes, bytes(r.kept), [(s.a, s.b) for s in r.spans]) for r in without_repeats(df, length).collect()), key=repr)


def repetitive(seed=5):
    rng = random.Random(seed)
    line = lambda n: "".join(rng.choice("abcde é") for _ in range(n))
    common, rows = [line(n) for n in (35, 60, 61, 150, 400)], []
    for i in range(120):
        parts = [line(rng.randrange(80))]
        for _ in range(rng.choice([0, 1, 1, 3])):
            text = rng.choice(common)
            if rng.random() < 0.3:
                k = rng.randrange(len(text))
                text = text[:k] + rng.choice("xyz") + text[k + 1 :]
            parts += [text, line(rng.randrange(80))]
        rows.append((i, "".join(parts)))
    rows += [(200, "x" * 500), (201, "ab" * 300), (202, "abcdefghij" * 90 + "!"), (203, rows[3][1]), (203, rows[3][1]), (None, rows[4][1])]
    return rows


@pytest.mark.parametrize(("contexts", "segment"), [(4096, 1 << 23), (3, 128)])
def test_repeats_equal_brute_force(table, monkeypatch, contexts, segment):
    monkeypatch.setattr(repeats, "CONTEXTS", contexts)
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    rows = repetitive()
    assert without(table(rows, 4), 60) == kept_bytes(rows, 60)


def test_repeats_of_odd_rows(odd, empty):
    assert without(odd, 20) == kept_bytes(ODD, 20)
    assert without_repeats(empty).collect() == []


def test_positional_transform_finds_equal_columns():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 3, (6, 50))
    x = base[rng.integers(0, 6, 60)].copy()
    x[rng.random(x.shape) < 0.04] = 7
    given = rng.random(x.shape) > 0.01
    group = np.sort(rng.integers(0, 5, 60))
    got = long_matches(x, given, group, 9)
    for a in range(60):
        for k in range(42):
            s = slice(k, k + 9)
            want = given[a, s].all() and any(b != a and group[b] == group[a] and given[b, s].all() and (x[a, s] == x[b, s]).all() for b in range(60))
            assert got[a, k] == want


# hard negatives

def hard(rows, every):
    rows = {i: (label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in (i for i in rows if i % every == 0):
        score = {i: sum(x * y for x, y in zip(v, rows[a][1])) for i, (_, v) in rows.items() if i != a}  # noqa: B905
        ranked = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in ranked if rows[i][0] == rows[a][0]][:5]:
            window = [i for i in ranked if rows[i][0] != rows[a][0] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(window[:3])]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, v string, score int").repartition(3)


@pytest.mark.parametrize(("asked", "members"), [(2048, 8192), (7, 40)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, asked, members):
    monkeypatch.setattr(negatives, "ROWS", members)
    monkeypatch.setattr(negatives, "ASKED", asked)
    monkeypatch.setattr(negatives, "SAMPLE", 64)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 12)).astype(np.float32)
    v[:90] = v[0]  # a third are copies, so scores tie
    v[100:130] *= 5
    rows = [(i, x.tolist(), int(k)) for i, (x, k) in enumerate(zip(v, rng.integers(0, 4, 300), strict=True))]
    rows += [(300, None, 1), (301, [math.nan] * 12, 1), (302, [1.0, None], 1), (303, [math.inf] * 12, 0), (305, v[5].tolist(), None),
             (310, v[5].tolist()[:7], 2), (320, [], 1), (330, [0.0] * 12, 3), (-10, v[9].tolist(), 0), (340, v[0].tolist(), 9)]
    found = hard_negatives(integer_vectors(vectors(spark, [*rows, rows[7], (None, v[0].tolist(), 1)])), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, found.collect())) == hard(rows, 10)


def test_no_vectors(spark):
    assert hard_negatives(integer_vectors(vectors(spark, [])), F.lit(True)).collect() == []
    assert hard_negatives(integer_vectors(vectors(spark, [(1, [1.0], 1)])), F.col("vec_id") == 2).collect() == []
    assert hard_negatives(integer_vectors(vectors(spark, [(1, [1.0], 1)])), F.lit(True)).collect() == []


@pytest.mark.parametrize("least", [-(10**9), -50, 0, 900, 4000, 10**9])
def test_threshold_join_loses_no_pair(least):
    rng = np.random.default_rng(3)
    rows = (rng.normal(size=(500, 20)) * rng.choice([1, 6, 20], (500, 1)) * np.linspace(1, 4, 20)).astype(np.int64)
    asked = (rng.normal(size=(40, 20)) * 9).astype(np.int64)
    t = np.full(40, least) + np.arange(40)
    found = {(a, r): s for part in threshold_join(rows, asked, t) for a, r, s in zip(*(x.tolist() for x in part), strict=True)}
    scores = asked @ rows.T
    assert found == {(a, r): scores[a, r] for a, r in zip(*(x.tolist() for x in np.nonzero(scores >= t[:, None])), strict=True)}


# collocations

def strongest(rows, least, top):
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate({k: k + 32 for k in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update(tuple(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        phrases = [p for p in f if len(p) > 1 and f[p] >= least]
        scored = []
        for p in phrases:
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * f[q] >= 50 * f[p] for q in phrases):
                continue
            s, k = min((1_000_000 * f[p] ** 2 // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top]):
            out.append((lang, rank + 1, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def spoken(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"W{k}" for k in range(30)] + ["é", "\x1cz", "漢字", "a-b", "'"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " \r\n", "?! "]
    rows = []
    for _ in range(120):
        text = "".join(rng.choice(["the ", "New york City", "of the "]) + rng.choice(vocabulary[: rng.choice([4, 35])]) + rng.choice(ends)
                       for _ in range(rng.randrange(60)))
        rows.append((text, rng.choice(["en", "en", "de", None])))
    return [*rows, (None, "fr"), ("", "en"), (" \t.", None), ("one two three", "it"), ("a " * 500, "xx"), *rows[:5]]


@pytest.mark.parametrize(("chunk", "slice_", "merged"), [(1 << 21, 1 << 22, 1 << 22), (200, 16, 1)])
def test_collocations_equal_brute_force(table, monkeypatch, chunk, slice_, merged):
    for name, value in (("CHUNK", chunk), ("SLICE", slice_), ("MERGED", merged), ("LEAST_SHARDS", 4)):
        monkeypatch.setattr(phrases, name, value)
    rows = spoken()
    got = collocations(table([(i, *r) for i, r in enumerate(rows)], 4), least=5, top=60)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == strongest(rows, 5, 60)


def test_collocations_of_odd_rows(odd, empty):
    got = collocations(odd, least=2).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == strongest([(t, "en") for _, t in ODD], 2, 2000)
    assert collocations(empty).collect() == []


@pytest.mark.parametrize("bits", [1, 6, 17, 22, 31, 40])
def test_filters_keep_every_count(bits):
    rng = np.random.default_rng(bits)
    words = [rng.integers(0, 1 << bits, 500).astype(np.uint64) for _ in range(3)]
    shape = Shape(bits, 4, 100)
    high, low = permuted(*packed(words, bits), shape.half)
    assert (high < 1 << shape.half).all() and (low < 1 << shape.half).all()
    shard = shape.shard_of(high)
    counts = rng.integers(1, 1000, 500)
    seen = Counter()
    for s in np.unique(shard):
        own = shard == s
        high_, low_, c = shape.decode(int(s), *shape.encode(*phrases._summed(high[own], low[own], counts[own])))
        back = unpacked(*permuted(high_, low_, shape.half, back=True), bits)
        seen.update({tuple(map(int, w)): int(n) for *w, n in zip(*back, c, strict=True)})
    want = Counter()
    for *w, n in zip(*words, counts, strict=True):
        want[tuple(map(int, w))] += int(n)
    assert seen == want


def test_a_document_of_many_lists_meets_its_component_once(spark, monkeypatch):
    import re

    from driftwatch.llm import minhash
    lists = spark.createDataFrame([(t, d, 9, d, [0]) for t in range(5) for d in range(4)], "token long, doc_id long, n long, code long, parity array<long>")
    found = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "id long, component long")
    monkeypatch.setattr(minhash, "stage", lambda df, name: df)
    got = minhash._mixed(lists, found)
    assert re.search(r"Generate explode\(tokens.*Join LeftOuter", got._jdf.queryExecution().optimizedPlan().toString(), re.S)
    rows = sorted((r["token"], r["doc_id"], r["n"], r["code"], r["parity"], r["group"], r["members"], r["hub"]) for r in got.collect())
    assert rows == sorted((t, d, 9, d, [0], 3 if d == 3 else 0, 4, 0) for t in range(5) for d in range(4))


@pytest.mark.parametrize("words", [10**8, 10**9, 10**10])
def test_merging_filters_holds_no_more_for_a_larger_table(words):
    """A shard has a bounded share of all n-grams, however many words there are."""
    shards = max(phrases.LEAST_SHARDS, phrases._power_of_two(words / phrases.SHARD))
    assert 2 * words / shards <= 1 << 21 and phrases.MERGED <= 1 << 20


def test_filters_are_taken_in_a_few_at_a_time(table, spark, monkeypatch):
    from driftwatch.llm import batches
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with batches.at_most(spark, 3):
        seen = spark.range(0, 20, 1, 2).mapInArrow(lambda bs: (type(b).from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect()
    assert sum(r["n"] for r in seen) == 20 and max(r["n"] for r in seen) == 3 and spark.conf.get(key) == before
    limits = []
    monkeypatch.setattr(phrases, "stage", lambda df, name: limits.append((name, int(spark.conf.get(key)))) or phrases_stage(df, name))
    phrases_stage = __import__("driftwatch.storage", fromlist=["stage"]).stage
    collocations(table([(i, *r) for i, r in enumerate(spoken())], 2), least=5, top=60).collect()
    assert dict(limits) == {"chunks": 1000, "word-counts": int(before), "vocabulary": int(before), "n-grams": 8}
