"""Quality rules, language machines and personal data: held-out accuracy, brute force, odd rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from driftwatch.llm import language, personal, quality
from driftwatch.llm.queries import QUERIES
from driftwatch.llm.sampling import held_out
from tests.conftest import SF
from tests.llm.conftest import ODD


def crc_held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_follows_the_checksum(spark):
    rows = spark.range(-50, 400).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == crc_held(r["id"]) for r in rows)


def test_quality_of_held_out_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op3_quality"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    told = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == crc_held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in told) >= 0.9 * len(told)


def test_quality_of_odd_rows(spark, odd, empty):
    some = spark.createDataFrame([(4, 1), (5, 0), (6, 1), (8, 0), (None, 1), (9, None), (10, 7)], "doc_id long, quality int")
    got = quality.quality(odd, some).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.quality(odd, some.where("false")).collect()} == {0.5}
    assert {r["predicted"] for r in quality.quality(odd, some.where("quality = 1")).collect()} == {1}
    assert quality.quality(empty, some).collect() == []


def test_rules_are_the_paths_of_the_trees():
    text = """RandomForest
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 2 <= 1.0E-4)
      Predict: 0.0
     Else (feature 2 > 1.0E-4)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0
"""
    assert quality.tree_paths(text) == [
        ((0, False, 0.5),), ((0, True, 0.5),), ((0, True, 0.5), (2, False, 1e-4)), ((0, True, 0.5), (2, True, 1e-4))]


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = QUERIES["op4_language"](spark, SF).collect()
    assert len(rows) == len(lang)
    told = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in told) >= 0.95 * len(told)


def test_language_of_odd_rows(spark, table, odd, empty):
    words = {"en": "the house and this thing", "de": "das haus und diese sache", "fr": "cette maison est très belle"}
    rng = random.Random(2)
    docs = table([(i, " ".join(rng.choices(words[k].split(), k=12)), k) for i in range(120) for k in [rng.choice(list(words))]])
    model = language.fit(docs)
    assert model["langs"] == ["de", "en", "fr"] and set(model["pairs"]) == {("de", "en")}
    got = language.languages(odd, model).collect()
    assert len(got) == len(ODD)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language.predict("das haus", model)[0] == "de" and language.predict("123 !!", model) == ("und", 0.0)
    assert language.predict("12²½", model) == ("und", 0.0) and language.predict("é", model)[0] != "und"
    nothing = language.fit(empty)
    assert {r["lang_pred"] for r in language.languages(odd, nothing).collect()} == {"und"}
    one = language.fit(docs.where("lang = 'fr'"))
    assert language.predict("the house", one) == ("fr", 1.0)
    kept = language.accepted(odd, model)
    assert kept.columns == odd.columns and kept.where("doc_id in (1, 2, 3)").count() == 0 and kept.count() == len(ODD) - 4


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


PATTERNS = {  # fixed values: the base patterns as they are stated
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(text):
    def good(kind, match):
        digits = re.sub("[^0-9]", "", match)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in match.split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
    found = sorted((m.start(), n, kind, m.end()) for n, (kind, p) in enumerate(PATTERNS.items())
                   for m in re.finditer(p, text or "") if good(kind, m[0]))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found)


TEXTS = [
    None, "", "a@b.c_d@e.f x@y", "mail é\U0001f600 me+you%x@host.example.org, 10.0.0.255 and 10.0.0.256 1.2.3.4.5.6.7.8",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 5500005555555559", "+1 (269) 555-3296 4524132264652876 end",
    "+12 345 678 901 2. +1 (269) 555-3296", "a@b@c.d @x.y z@.q 999999999999999999999999.1.1.1 00000000001.2.3.4",
    "1" * 5000 + " " + "a." * 4000 + "@" + "b." * 4000 + "c", "+" * 50 + "1234567890", "no data here at all"]


def test_base_spans_equal_plain_regular_expressions(table, empty):
    rng = random.Random(4)
    parts = ["a@b.co", "1.2.3.4", "+1 (2) 3", "4111111111111111", " ", "-", "x", "é", "@", ".", "+", "7"]
    texts = TEXTS + ["".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(300)]
    docs = table(list(enumerate(texts)))
    got = {r["doc_id"]: r for r in personal.digests(personal.find(docs, {"trees": [], "thresholds": {}})).collect()}
    for i, t in enumerate(texts):
        want = base(t)
        assert got[i]["spans"] == want, t
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert got[i]["n_email"] == want.count("email:") and got[i]["n_phone"] == want.count("phone:")
    assert personal.find(empty, {"trees": [], "thresholds": {}}).collect() == []


def test_model_only_adds_spans_beside_the_base(spark, table):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        number = "".join(rng.choices("0123456789", k=10))
        mail = "".join(rng.choices("abcdef", k=6))
        rows.append((i, rng.choice([
            f"call +{number[:1]} ({number[1:4]}) {number[4:7]}-{number}", f"phone +{number} now", f"mail {mail}@{mail}.com",
            f"order {number[:8]} of {number[:9]}", f"host {number[:1]}.{number[1:3]}.{number[3:5]}.1", f"see {mail}@{mail} soon"])))
    docs = table(rows)
    model = personal.fit(docs)
    assert model["trees"]
    for r in personal.find(docs, model).collect():
        spans = {tuple(s) for s in r["spans"]}
        assert {tuple(s) for s in r["base"]} <= spans
        for start, _, end in spans:
            assert 0 <= start < end <= len(r["text"])
    assert personal.fit(docs.where("false"))["trees"] == []


DISGUISED = [
    ("please contact bob.smith (at) host.org today", "0", "bob.smith (at) host.org"), ("write an email to ann[at]mail.example.com soon", "0", "ann[at]mail.example.com"),
    ("call (269) 555-3296 now", "3", "(269) 555-3296"), ("phone 2695553296 now", "3", "2695553296"), ("mobile: 1 (269) 555-3296 now", "3", "1 (269) 555-3296"),
    ("credit card 4111.1111.1111.1111 paid", "2", "4111.1111.1111.1111"), ("card 5018 0000 0009 paid", "2", "5018 0000 0009"),
    ("visa 4222222222222 paid", "2", "4222222222222"), ("server address 10:20:30:40 down", "1", "10:20:30:40")]
ORDINARY = ["we sent order 2695553296 out", "the order number 12345678 is due", "invoice 4222222222222 is open", "call about order 2695553296 soon",
            "version 2.13.4 is out", "it was 12:30:45 then", "on 2024-01-15 we met", "bob @home again", "a token 9a10d19030926318f5d here"]


def test_disguised_data_is_added_and_an_order_number_is_not(table):
    rng = random.Random(11)
    rows = []
    for i in range(900):
        n = "".join(rng.choices("0123456789", k=15))
        card = next(n[:15] + d for d in "0123456789" if luhn(n[:15] + d))
        name = "".join(rng.choices("abcdef", k=6))
        rows.append((i, rng.choice(["some words here {} and more", "as it is told, {} then", "call {} now", "order {} now", "at {}."]).format(rng.choice([
            f"+1 ({n[:3]}) {n[3:6]}-{n[6:10]}", f"{name}@{name}.com", card, f"{n[0]}.{n[1:3]}.{n[3]}.1", n[:9]]))))
    disguised = [(1000 + i, t) for i, (t, _, _) in enumerate(DISGUISED)]
    ordinary = [(2000 + i, t) for i, t in enumerate(ORDINARY)]
    found = personal.find(table(disguised + ordinary), personal.fit(table(rows + disguised * 2)))
    got = {r["doc_id"]: r for r in found.collect()}
    for i, (t, kind, span) in enumerate(DISGUISED):
        row = got[1000 + i]
        assert row["base"] == [] and (t.index(span), int(kind), t.index(span) + len(span)) in {tuple(s) for s in row["spans"]}, (t, row["spans"])
    assert {t: got[2000 + i]["spans"] for i, t in enumerate(ORDINARY) if got[2000 + i]["spans"]} == {}


def test_trees_as_columns_equal_the_fitted_model(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = personal.FEATURES
    rows = spark.range(300).select("id", *(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(20)).cast("double").alias(n) for k, n in enumerate(names)))
    rows = rows.withColumn("label", ((F.col(names[1]) > 8) & (F.col(names[4]) < 15)).cast("double"))
    vectors = VectorAssembler(inputCols=names, outputCol="vector").transform(rows)
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=5, maxDepth=3, seed=1).fit(vectors)
    both = model.transform(vectors).select(
        vector_to_array("probability")[1].alias("a"), personal.score(personal.trees(model), F.struct(*names)).alias("b")).collect()
    assert all(r["a"] == pytest.approx(r["b"]) for r in both)


def test_redaction_keeps_the_rest(table):
    docs = table([(1, "me a@b.co and 1.2.3.4!"), (2, None), (3, "nothing")])
    got = {r["doc_id"]: r["text"] for r in personal.redact(personal.find(docs, {"trees": [], "thresholds": {}})).collect()}
    assert got == {1: "me ****** and *******!", 2: "", 3: "nothing"}


def test_every_document_and_every_base_span_gives_examples(spark):
    docs = spark.range(21_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("write to ann@mail.org"), F.when(
        F.col("id") == 5, F.repeat(F.lit(" or bob@host.net"), 8)).otherwise("")).alias("text"))
    made = personal.counted_examples(docs).where("label = 1 and number = 0").agg(F.sum("n").alias("n")).first()["n"]
    assert made == 21_008  # one disguised address for each
