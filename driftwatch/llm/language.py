"""Language of a text by hierarchical discrimination: family first, then one-versus-one linear support vector machines."""

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm import batches, words
from driftwatch.llm.sampling import held_out
from driftwatch.storage import stage

# fixed values: families of languages that are easily confused; any other language is a family of its own
FAMILIES = {
    "germanic": ["en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "bg", "pl", "cs", "sk", "sl", "hr", "sr"],
}
UNKNOWN = "und"
CLASSES = 2048  # hash classes of byte pairs and triples
TRAIN_ROWS = 1000  # documents of each language to learn from, at most about
_PLAIN = np.arange(256, dtype=np.uint32)
_PLAIN[[b for b in range(128) if not chr(b).isalpha()]] = 32


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), f"only {lang}")


def profile(text: str) -> np.ndarray:
    """Square roots of the shares of byte pairs and triples of the whole lower-cased text, by hash class, at length 1."""
    data = _PLAIN[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    counts = np.zeros(CLASSES)
    for a in range(0, len(data) - 1, words.BLOCK):
        part = data[a : a + words.BLOCK + 2]
        pairs = part[:-1] | part[1:] << np.uint32(8)
        grams = [pairs[: words.BLOCK][pairs[: words.BLOCK] != 0x2020] + np.uint32(1 << 24)]
        if len(part) > 2:
            triples = pairs[:-1] | part[2:] << np.uint32(16)
            grams.append(triples[triples & np.uint32(0xFFFF) != 0x2020])
        for g in grams:
            counts += np.bincount((g * np.uint32(2654435761)) >> np.uint32(21), minlength=CLASSES)
    return np.sqrt(counts / max(1.0, counts.sum()))


def _profiles(docs: DataFrame) -> DataFrame:
    def run(found):
        for sub in batches.slices(found):
            flat = np.concatenate([profile(t or "") for t in sub.column(1).to_pylist()])
            offsets = pa.array(np.arange(0, len(flat) + 1, CLASSES), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [sub.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["lang", "profile"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, profile array<double>")


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """Learn from the text and lang of `docs` outside the held-out third, at most about `train_rows` of each language.

    Returns families, the weights of the family model, and the weights of a machine for each pair within a family.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("lang")).where(~held_out()).where(F.col("lang").isNotNull())
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return {"langs": []}
    share = F.create_map(*itertools.chain.from_iterable(
        (F.lit(k), F.lit(int(min(1.0, train_rows / n) * (1 << 20)))) for k, n in counts.items()))
    sample = known.where(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 20)) < share[F.col("lang")])
    train = stage(_profiles(sample.repartition(8)), "profiles").withColumn("x", array_to_vector("profile"))
    families = sorted({family(x) for x in langs})
    model = {"langs": langs, "families": families, "pairs": {}}
    if len(families) > 1:
        number = F.create_map(*itertools.chain.from_iterable(
            (F.lit(x), F.lit(float(families.index(family(x))))) for x in langs))
        fitted = LogisticRegression(featuresCol="x", family="multinomial", regParam=1e-4, maxIter=30).fit(
            train.select("x", number[F.col("lang")].alias("label")))
        model["family"] = (fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray())
    for f in families:
        for a, b in itertools.combinations([x for x in langs if family(x) == f], 2):
            machine = LinearSVC(featuresCol="x", regParam=1e-4, maxIter=30, standardization=False).fit(
                train.where(F.col("lang").isin(a, b)).select("x", (F.col("lang") == a).cast("double").alias("label")))
            model["pairs"][a, b] = (machine.coefficients.toArray(), float(machine.intercept))
    return model


def predict(text: str | None, model: dict) -> tuple[str, float]:
    """Language and score from 0 to 1: the family's probability times the mean support of the language within it."""
    if not model["langs"] or text is None or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    x, sure, chosen = profile(text), 1.0, model["families"][0]
    if "family" in model:
        z = model["family"][0] @ x + model["family"][1]
        p = np.exp(z - z.max())
        p /= p.sum()
        sure, chosen = float(p.max()), model["families"][int(p.argmax())]
    members = [y for y in model["langs"] if family(y) == chosen]
    support = dict.fromkeys(members, 0.0)
    votes = dict.fromkeys(members, 0)
    for (a, b), (weights, intercept) in model["pairs"].items():
        if a in support:
            margin = float(weights @ x) + intercept
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, 2 * margin))))
            support[a] += p
            support[b] += 1 - p
            votes[a if margin >= 0 else b] += 1
    best = max(members, key=lambda y: (votes[y], support[y]))
    return best, sure * (support[best] / (len(members) - 1) if len(members) > 1 else 1.0)


def languages(docs: DataFrame, model: dict) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, lang_pred, score, from whole texts.

    `und` and 0 for a null text or one without a letter, and for all if nothing was learned. A null doc_id is held out; repeated rows are predicted
    each; other columns do not matter; an empty table gives an empty result.
    """
    def run(found):
        for sub in batches.slices(found):
            out = [predict(t, model) for t in sub.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [sub.column(0), sub.column(1), pa.array([r[0] for r in out], pa.string()),
                 pa.array([r[1] for r in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: dict, langs: set[str] | None = None) -> DataFrame:
    """The rows of `docs` whose text has a recognised language (one of `langs`, if given), with all columns as they are."""
    at = docs.columns.index("text")

    def known(texts):
        return [x != UNKNOWN and (langs is None or x in langs) for x in (predict(t, model)[0] for t in texts)]

    return docs.mapInArrow(lambda found: batches.chosen(found, at, known), docs.schema)
