"""Document quality by a sparse ensemble of rules.

Trees over text statistics are fitted on a bounded sample; every path from a root to a node is a rule (a conjunction of
limits on statistics). A lasso logistic regression picks and weighs the rules, and the rules with a weight become one
Spark column expression, which scores all documents.
"""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm import words
from driftwatch.llm.sampling import bounded, held_out
from driftwatch.storage import stage

STATISTICS = ["log_bytes", "log_words", "word_bytes", "letters", "capitals", "digits", "symbols", "bars", "bangs", "ends",
              "lines", "line_repeats", "distinct_words", "top_word", "echoes", "distinct_pairs"]
TRAIN_ROWS = 20_000  # labelled documents that the rules are fitted on, at most
TREES, DEPTH, LASSO = 20, 3, 0.002

_CLASS = np.zeros((8, 256), bool)  # letters, capitals, digits, symbols, bars, bangs, sentence ends, line ends
_CLASS[0, 97:123] = _CLASS[0, 65:91] = _CLASS[0, 128:] = True
_CLASS[1, 65:91] = True
_CLASS[2, 48:58] = True
_CLASS[3, [ord(c) for c in "#$%&*+/<=>@\\^_`{}~"]] = True
_CLASS[4, ord("|")] = True
_CLASS[5, ord("!")] = True
_CLASS[6, [ord(c) for c in ".?"]] = True
_CLASS[7, ord("\n")] = True


def _measures(text, hashes):
    """The statistics of one byte string with its word hashes; shares are 0 where there is nothing to count."""
    size, n = len(text), len(hashes)
    data = np.frombuffer(text, np.uint8)
    counts = np.bincount(data, minlength=256) @ _CLASS.T
    shares = counts / max(1, size)
    lines = text.split(b"\n")
    full = [x for x in lines if x]
    kinds, times = np.unique(hashes, return_counts=True)
    pairs = np.unique(words.mix(hashes[:-1]) + hashes[1:])
    return [math.log1p(size), math.log1p(n), (size - n) / max(1, n), shares[0], shares[1], shares[2], shares[3], shares[4], shares[5],
            counts[6] / max(1, n), counts[7] / max(1, n), 1 - len(set(full)) / max(1, len(full)), len(kinds) / max(1, n),
            times.max() / n if n else 0.0, float((hashes[1:] == hashes[:-1]).sum()) / max(1, n - 1),
            len(pairs) / max(1, n - 1)]


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, the STATISTICS) of every row, from whole texts. Null and empty texts have zeros."""
    def run(batches):
        for batch in batches:
            for sub in (batch.slice(a, 1000) for a in range(0, batch.num_rows, 1000)):
                texts = [t or b"" for t in sub.column(1).cast(pa.binary()).to_pylist()]
                rows = []
                for a, b in words.blocks(texts):
                    hashes, offsets = words.word_hashes(texts[a:b])
                    rows += [_measures(t, hashes[offsets[i] : offsets[i + 1]]) for i, t in enumerate(texts[a:b])]
                table = np.array(rows, float).reshape(-1, len(STATISTICS))
                yield pa.RecordBatch.from_arrays(
                    [sub.column(0), *(pa.array(table[:, k]) for k in range(table.shape[1]))], ["doc_id", *STATISTICS])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{c} double" for c in STATISTICS))


def tree_paths(text: str) -> list[tuple]:
    """All conjunctions (feature, is upper limit, limit) from the roots of the trees in Spark's description of them."""
    found, path = {}, []
    for line in text.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if not m:
            if line.strip().startswith("Tree "):
                path = []
            continue
        indent = len(m[1])
        while path and path[-1][0] >= indent:
            path.pop()
        path.append((indent, (int(m[3]), m[4] == "<=", float(m[5]))))
        found[tuple(sorted(c for _, c in path))] = True
    return sorted(found)


def rule(conditions: tuple, names: list[str]) -> Column:
    out = F.lit(True)
    for feature, upper, limit in conditions:
        out = out & (F.col(names[feature]) <= limit if upper else F.col(names[feature]) > limit)
    return out


def fit(table: DataFrame, label: str, names: list[str], seed: int = 11) -> tuple[float, list[tuple[tuple, float]]]:
    """Intercept and the rules with their weights, from a small table with a 0/1 label; no rules if it has one class."""
    classes = {r[0]: r[1] for r in table.groupBy(label).count().collect()}
    total = sum(classes.values())
    if len(classes) < 2:
        return (0.0 if not total else 20.0 * (2 * next(iter(classes)) - 1)), []
    vectors = VectorAssembler(inputCols=names, outputCol="x").transform(table).select(
        F.col(label).cast("double").alias("label"), "x", *names).coalesce(8)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed,
                                    featureSubsetStrategy="onethird").fit(vectors.select("x", "label"))
    rules = tree_paths(forest.toDebugString)
    if not rules:
        return math.log(classes[1] / classes[0]), []
    fired = vectors.select("label", *(rule(r, names).cast("double").alias(f"r{k}") for k, r in enumerate(rules)))
    weight = F.when(F.col("label") == 1, total / (2 * classes[1])).otherwise(total / (2 * classes[0]))
    fired = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="x").transform(fired).select(
        "label", "x", weight.alias("w"))
    lasso = LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", elasticNetParam=1.0, regParam=LASSO,
                               standardization=False, maxIter=60).fit(fired)
    return float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, lasso.coefficients, strict=True) if w]


def score(intercept: float, rules: list[tuple[tuple, float]], names: list[str]) -> Column:
    """The probability of label 1 as one column expression."""
    total = F.lit(intercept)
    for conditions, weight in rules:
        total = total + F.when(rule(conditions, names), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, score, predicted.

    Learns from at most about `train_rows` labelled documents outside the held-out third, chosen by hash; scores the whole text of
    every document from its STATISTICS alone. Labels that are null or neither 0 nor 1 are ignored; several labels of one document
    count as their maximum. With one class of labels only, that class is predicted for all; without labels the score is 0.5. Null and
    empty texts have a score like others. A null doc_id is held out. Rows that repeat are scored each; other columns
    do not matter; an empty table gives an empty result.
    """
    stats = stage(statistics(docs), "statistics")
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
             .where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label")))
    sample = bounded(known.where(~held_out()), "doc_id", train_rows)
    train = stage(stats.join(sample, "doc_id"), "train")
    intercept, rules = fit(train, "label", STATISTICS)
    return stats.select("doc_id", held_out().alias("held_out"), score(intercept, rules, STATISTICS).alias("score")
                        ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
