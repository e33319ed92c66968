"""Exact and near copies against brute force."""

import random
import re

import pytest

from driftwatch.llm import minhash, words
from driftwatch.llm.components import components
from driftwatch.llm.copies import exact_duplicates
from driftwatch.llm.minhash import match_threshold, near_duplicates
from tests.llm.conftest import ODD


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1)))


def brute(rows, size, num, den):
    """component of each doc_id by comparing all pairs."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    common = [rng.choice(vocabulary) for _ in range(60)]
    rows, n = [], 0
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120]))]
        if group % 3 == 0:
            base = base + common
        for _ in range(rng.choice([1, 2, 5, 40])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((n, " ".join(text)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "num", "short"), [(3, 85, 24), (5, 80, 2)])
def test_near_copies_equal_all_pairs(table, size, num, short):
    rows = corpus()
    got = {r.doc_id: r for r in near_duplicates(table(rows), size, num, 100, short=short).collect()}
    want = brute(rows, size, num, 100)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(shingles(t, size)) for i, t in rows}
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_documents_meet_their_component_once_a_round(table, monkeypatch):
    rng = random.Random(8)
    base = [rng.choice("abcdefgh") + str(k) for k in range(90)]
    rows = []
    for i in range(70):  # two groups around one text, whose members share long lists
        text = base[:60] + [f"z{k}" for k in range(30)] if i % 2 else list(base)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(90)] = f"y{i}"
        rows.append((i, " ".join(text)))
    calls = {"components": 0, "_grouped": 0, "_mixed": 0}

    def counted(name, f):
        def run(*args):
            calls[name] += 1
            return f(*args)
        return run

    for name in calls:
        monkeypatch.setattr(minhash, name, counted(name, getattr(minhash, name)))
    got = {r.doc_id: r.component_id for r in near_duplicates(table(rows), 3, 85, 100, short=2).collect()}
    assert got == brute(rows, 3, 85, 100)
    assert calls["_grouped"] == calls["components"] and calls["_mixed"] > 1 + calls["components"]


def test_near_copies_of_odd_rows(odd, empty):
    rows = near_duplicates(odd, 3, 85, 100).collect()
    assert len(rows) == len(ODD)
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert {i: r.component_id for i, r in got.items()} == brute(ODD, 3, 85, 100)
    assert [got[i].n_shingles for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1]
    assert sorted(str(r.kept) for r in rows if r.doc_id is None) == ["False", "True"]
    assert near_duplicates(empty, 3, 85, 100).collect() == []


def test_threshold_misses_almost_nothing():
    assert match_threshold(0.85, 32) == 13
    assert match_threshold(0.8, 32) < match_threshold(0.85, 32) < match_threshold(0.85, 64)


def test_word_hashes_do_not_depend_on_the_block():
    texts = [t.encode() for t in ("a b  c", "", "C\tB a", "a b c" + " x" * 1000)]
    alone = [words.word_hashes([t])[0].tolist() for t in texts]
    hashes, offsets = words.word_hashes(texts)
    assert [hashes[offsets[i] : offsets[i + 1]].tolist() for i in range(4)] == alone
    assert alone[0] == alone[2][::-1] and alone[0] == alone[3][:3] and alone[1] == []


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40, 60)] + [(7, i) for i in range(100, 130)] + [(3, 3), (None, 5), (130, 129)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 40 for i in range(40, 61)}, **{i: 7 for i in [7, *range(100, 131)]}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_copies(table, odd, empty, keep):
    rng = random.Random(1)
    rows = [(i, rng.choice(["the same long head of a text " + "a" * rng.randrange(4), "other", None, ""])) for i in range(300)]
    for data, df in ((rows, table(rows, 7)), (ODD, odd)):
        groups = {}
        for i, t in data:
            groups.setdefault(t or "", []).append(i)
        pick = max if keep == "largest" else min
        got = exact_duplicates(df, keep=keep).collect()
        assert len(got) == len(data)
        want = sorted((str(i), str(pick(k) if (k := [x for x in groups[t or ""] if x is not None]) else None), len(groups[t or ""]))
                      for i, t in data)
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)
    assert exact_duplicates(empty).collect() == []


def test_exact_copies_after_normalising(table):
    from pyspark.sql import functions as F

    got = exact_duplicates(table([(1, "A b"), (2, "a  B"), (3, "ab")]), lambda t: F.lower(F.regexp_replace(t, r"\s+", " "))).collect()
    assert sorted((r.doc_id, r.keep_id) for r in got) == [(1, 1), (2, 1), (3, 3)]
