"""Documents that hold test items: BM25 over an inverted index of the items, block-max WAND, then overlap checks.

The index holds the items, and every passage of every document is a query. An item's weights are divided by its score
against itself, so one threshold (a share of the item's own score) serves all. Passages overlap by half and are at
least twice as long as the longest item, so an item that stands in a document stands whole in one passage. Items that
pass the threshold are confirmed by the shares of word runs that the passage holds: of question and answer, of the whole item, or
of a question that stands alone. So an item with an edited or missing answer is found too.
"""

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm import batches, words
from driftwatch.storage import stage

K1, B = 1.2, 0.75
SHARE = 0.5  # of an item's own score that a passage must reach
OVERLAP = 0.6  # share of the question's and of the answer's word runs, or of the whole item's
ALONE = 0.9, 8  # share of a question's word runs that suffices by itself, and how many runs it must have for that
RUN = 5  # words in a run
PASSAGE = 128  # words in a passage, at least
BLOCK = 32  # postings under one maximum
NEAR = 2  # items under one maximum in the first sieve
CELLS = 4_000_000  # sums that the sieve holds at once
FREQUENT = 0.1  # share of any item's score that the terms left out of the first sieve may make
MAX_WORDS = 1_000_000  # words of items in one index; more items are searched in slices, one pass each


def _runs(hashes, size):
    size = min(size, len(hashes))
    if not size:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - size + 1] * words._PLACE[0]
    for k in range(1, size):
        out = out + hashes[k : len(hashes) - size + 1 + k] * words._PLACE[k]
    return np.unique(words.mix(out + np.uint64(size)))


def question_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer; a single sentence is cut after two thirds of its words."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+", text.strip()) if re.search(r"\w", p)]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    each = text.split()
    cut = max(1, -(-2 * len(each) // 3))
    return " ".join(each[:cut]), " ".join(each[cut:])


def _hash(text):
    return words.word_hashes([text.lower().encode("utf-8", "replace")], words.SIGNS)[0]


class Index:
    """Postings of some items, with global document frequencies."""

    def __init__(self, items, frequency, total, mean):
        """items: (item_id, text); frequency: how many of all `total` items hold a term; mean: their mean length."""
        self.ids, self.checks, lists, self.longest = [], [], {}, 1
        for item_id, text in items:
            hashes = _hash(text)
            if not len(hashes):
                continue
            terms, times = np.unique(hashes, return_counts=True)
            df = np.array([frequency[int(t)] for t in terms], float)
            idf = np.log1p((total - df + 0.5) / (df + 0.5))
            weight = idf * times * (K1 + 1) / (times + K1 * (1 - B + B * len(hashes) / mean))
            weight /= weight.sum()
            for t, w in zip(terms.tolist(), weight.tolist(), strict=True):
                lists.setdefault(t, []).append((len(self.ids), w))
            question, answer = question_answer(text)
            q, a = _hash(question), _hash(answer)
            self.checks.append((_runs(q, RUN), min(RUN, len(q)), _runs(a, RUN), min(RUN, len(a)), _runs(hashes, RUN), min(RUN, len(hashes))))
            self.ids.append(item_id)
            self.longest = max(self.longest, len(hashes))
        self.terms = np.array(sorted(lists), np.uint64)
        self.postings = []
        for t in self.terms.tolist():
            at, w = zip(*lists[t], strict=True)
            at, w = np.array(at), np.array(w)
            blocks = [w[k : k + BLOCK].max() for k in range(0, len(w), BLOCK)]
            self.postings.append((at.tolist(), w.tolist(), blocks, float(w.max())))
        # the terms in most items are left to the search proper, as long as no item gets more than FREQUENT from them
        self.sieve = np.ones(len(self.terms), bool)
        gained = np.zeros(len(self.ids))
        for k in sorted(range(len(self.terms)), key=lambda k: -len(self.postings[k][0])):
            after = gained.copy()
            after[self.postings[k][0]] += self.postings[k][1]
            if after.max(initial=0) > FREQUENT:
                break
            gained, self.sieve[k] = after, False
        self.left_out = float(gained.max(initial=0))
        # maxima of each sieved term over groups of NEAR items, one after the other
        tops = []
        for k, (at, w, _, _) in enumerate(self.postings):
            best = {}
            for item, x in zip(at, w, strict=True) if self.sieve[k] else ():
                best[item // NEAR] = max(best.get(item // NEAR, 0.0), x)
            tops.append(best)
        self.top_from = np.concatenate(([0], np.cumsum([len(t) for t in tops]))).astype(np.int64)
        self.top_group = np.array([g for t in tops for g in t], np.int64)
        self.top_value = np.array([x for t in tops for x in t.values()])
        self.groups = len(self.ids) // NEAR + 1
        self.passage = max(PASSAGE, 2 * self.longest)

    def search(self, terms, least):
        """Items that score `least` or more against a set of terms (positions in self.terms): block-max WAND."""
        lists = [self.postings[t] for t in terms]
        cursor = [0] * len(lists)
        live = list(range(len(lists)))
        found = []
        least -= 1e-9
        while True:
            live = [k for k in live if cursor[k] < len(lists[k][0])]
            live.sort(key=lambda k: lists[k][0][cursor[k]])
            reach = 0.0
            for place, k in enumerate(live):
                reach += lists[k][3]
                if reach >= least:
                    break
            else:
                return found
            item = lists[live[place]][0][cursor[live[place]]]
            while place + 1 < len(live) and lists[live[place + 1]][0][cursor[live[place + 1]]] == item:
                place += 1
            reach, next_item = 0.0, None
            for k in live[: place + 1]:
                at, _, blocks, _ = lists[k]
                c = cursor[k]
                while c + BLOCK < len(at) and at[min(len(at), (c // BLOCK + 1) * BLOCK) - 1] < item:
                    c = (c // BLOCK + 1) * BLOCK
                reach += blocks[c // BLOCK]
                end = at[min(len(at), (c // BLOCK + 1) * BLOCK) - 1] + 1
                next_item = end if next_item is None else min(next_item, end)
            if reach < least:  # no item up to the end of these blocks can reach it
                target = max(item + 1, next_item)
                if place + 1 < len(live):
                    target = min(target, lists[live[place + 1]][0][cursor[live[place + 1]]])
                target = max(target, item + 1)
                for k in live[: place + 1]:
                    cursor[k] = self._skip(lists[k][0], cursor[k], target)
            elif lists[live[0]][0][cursor[live[0]]] == item:
                score = sum(lists[k][1][cursor[k]] for k in live[: place + 1])
                if score >= least:
                    found.append((item, score))
                for k in live[: place + 1]:
                    cursor[k] += 1
            else:
                for k in live[: place + 1]:
                    cursor[k] = self._skip(lists[k][0], cursor[k], item)

    @staticmethod
    def _skip(at, c, target):
        while c < len(at) and at[c] < target:
            block_end = min(len(at), (c // BLOCK + 1) * BLOCK)
            c = block_end if at[block_end - 1] < target else c + 1
        return c

    def _promising(self, passage, term, passages, share):
        """Passages in which some group of items may reach `share`, by the sums of the terms' maxima over the group."""
        slab = max(1, CELLS // self.groups)  # passages whose sums are held at once
        found = []
        for first in range(0, passages, slab):
            a, b = np.searchsorted(passage, (first, first + slab))
            here, part = term[a:b], passage[a:b] - first
            size = self.top_from[here + 1] - self.top_from[here]
            ends = np.cumsum(size)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.top_from[here] - ends + size, size)
            reach = np.bincount(np.repeat(part, size) * self.groups + self.top_group[at], self.top_value[at],
                                minlength=min(slab, passages - first) * self.groups)
            best = reach.reshape(-1, self.groups).max(axis=1)
            found += (first + np.flatnonzero(best >= share - self.left_out - 1e-9)).tolist()
        return found

    def leaks(self, hashes, share, overlap):
        """{item number: (score, question share, answer share)} of one document's word hashes."""
        if not len(self.terms) or not len(hashes):
            return {}
        term = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        hit = self.terms[term] == hashes
        essential = np.flatnonzero(hit & self.sieve[term])
        half = self.passage // 2
        last = max(0, (len(hashes) - 1) // half - 1) if len(hashes) > self.passage else 0
        # a word belongs to the passages that start at its half and at the half before
        part = essential // half
        pairs = np.concatenate((part, part - 1)) * len(self.terms) + np.concatenate((term[essential],) * 2)
        pairs = np.unique(pairs[pairs >= 0])
        passage, which = pairs // len(self.terms), pairs % len(self.terms)
        keep = passage <= last
        out = {}
        for p in self._promising(passage[keep], which[keep], last + 1, share):
            here = slice(p * half, len(hashes) if p == last else p * half + self.passage)
            inside = np.unique(term[here][hit[here]])
            runs = {}
            for item, score in self.search(inside.tolist(), share):
                q, nq, a, na, whole, nw = self.checks[item]
                for n in (nq, na, nw):
                    if n not in runs:
                        runs[n] = _runs(hashes[here], n) if n else np.zeros(0, np.uint64)
                *got, every = [float(np.isin(w, runs[n], assume_unique=True).mean()) if len(w) else 1.0
                               for w, n in ((q, nq), (a, na), (whole, nw))]
                alone = got[0] >= max(overlap, ALONE[0]) and len(q) >= ALONE[1]
                if (max(min(got), every) >= overlap or alone) and (item not in out or (min(got), score) > (min(out[item][1:]), out[item][0])):
                    out[item] = (score, *got)
        return out

    def each(self, texts, share, overlap):
        """Leaks of every text of a list."""
        data = [(t or "").lower().encode("utf-8", "replace") for t in texts]
        for a, b in words.blocks(data, words.BLOCK // 4):
            hashes, offsets = words.word_hashes(data[a:b], words.SIGNS)
            for i in range(b - a):
                yield self.leaks(hashes[offsets[i] : offsets[i + 1]], share, overlap)


def indexes(benchmark: DataFrame, max_words: int = MAX_WORDS):
    """Indexes over all items, one after the other, each of about `max_words` words at most."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                             F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.col("item_id").isNotNull())

    def terms(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                hashes = _hash(text)
                found = np.unique(hashes).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(hashes)], pa.int64()),
                     pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))], ["n", "terms"])

    told = stage(items.select("text").mapInArrow(terms, "n long, terms array<long>").where("n > 0"), "item-terms")
    total, size = told.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    slices = max(1, -(-size // max_words))
    frequency = told.select(F.explode("terms").alias("term")).groupBy("term").count()
    for k in range(slices):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k)
        # about max_words words of text and as many terms at most
        rows = sorted((r.item_id, r.text) for r in mine.collect())
        own = {int(h) for _, text in rows for h in _hash(text).view(np.int64)}
        df = {}
        if slices == 1:
            df = {r.term: r["count"] for r in frequency.collect()}
        elif own:
            wanted = items.sparkSession.createDataFrame([(h,) for h in own], "term long")
            df = {r.term: r["count"] for r in frequency.join(wanted, "term", "left_semi").collect()}
        yield Index(rows, {t % 2**64: n for t, n in df.items()}, total, max(1.0, size / max(1, total)))


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, overlap: float = OVERLAP,
          max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every document and test item found in it.

    An item is found where a passage reaches `share` of the item's own BM25 score and holds `overlap` of the word runs of both its question and
    its answer (the last sentence), or of the whole item, or nearly all of a question that is not short. Score is the part of the item's own BM25
    score that the best passage reaches. Words are runs of letters and digits in lower case.
    Null and empty texts, and items without words or item_id, match nothing; items that share an item_id count as one, with the best values.
    Repeated documents get their rows each; a null doc_id stays null; other columns do not matter; empty tables give
    an empty result.
    """
    out = None
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    for index in indexes(benchmark, max_words):
        shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(index))  # with its code: workers need no package

        def run(parts, shared=shared):
            index = pickle.loads(shared.value)
            for batch in batches.slices(parts):
                found = []
                for doc, items in zip(batch.column(0).to_pylist(),
                                      index.each(batch.column(1).to_pylist(), share, overlap), strict=True):
                    best = {}
                    for i, x in items.items():
                        best[index.ids[i]] = max(best.get(index.ids[i], x), x)
                    found += [(doc, i, *x) for i, x in best.items()]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (
                            pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)],
                        ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = rows.mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, overlap: float = OVERLAP,
          max_words: int = MAX_WORDS) -> DataFrame:
    """The rows of `docs` in which no test item is found, with all columns as they are."""
    at = docs.columns.index("text")
    for index in indexes(benchmark, max_words):
        shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(index))  # with its code: workers need no package

        def run(found, shared=shared):
            index = pickle.loads(shared.value)
            yield from batches.chosen(found, at, lambda texts: [not x for x in index.each(texts, share, overlap)])

        docs = docs.mapInArrow(run, docs.schema)
    return docs
