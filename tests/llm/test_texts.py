"""Chat formatting, HTML extraction, decontamination, mixing and WARC against brute force and SQL."""

import random
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from check import TABLES, rows_of
from driftwatch.llm import chat, decontaminate, html, mixing, warc
from driftwatch.llm.queries import ORACLES, QUERIES
from driftwatch.storage import new_path
from tests.conftest import SF
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.execute(ORACLES[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, rel.fetchall())


HARD = ["", " ", "</s>", "[INST]", "[\\INST] [\\\\INST]", "</s>[INST] ok [/INST]", "[/INST", "a [OUT] b </s> c", "<", "[[INST]]",
        "\\", "$1 \\2", "[ROLE] 3:abc [/ROLE]", "é\U0001f600\n\t[SYS]", "[INST", "]", "<</s>s>"]


def test_chats_come_back_exactly(spark):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "1:x", "", None, "[INST]"]
    rows = [(c, t, rng.choice(roles), rng.choice([*HARD, None])) for c in range(150) for t in range(rng.randrange(1, 7))]
    rows += [(None, 0, "user", "x"), (7, None, "user", "y"), (7, 0, "user", "same"), (7, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = chat.formatted(df).collect()
    source = {}
    for c, t, r, x in rows:
        source.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    assert len(got) == len(source)
    for r in got:
        want = [x[1:] for x in sorted(source[r["conv_id"]])]
        assert r["round_trip"] and [(t["role"], t["text"]) for t in r["turns"]] == want
        said = [r["formatted"][s["start"]:s["end"]] for s in r["loss"]]
        assert [spark_free_unescape(s) for s in said] == [x for role, x in want if role == "assistant"]
    assert chat.formatted(df.where("false")).collect() == []


def spark_free_unescape(text):
    import re
    return re.sub(r"([\[<])\\(\\*)" + chat.BODY, r"\1\2\3", text)


def test_only_conflicting_chats_are_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "a < b [x]"), (2, 0, "user", "</s>")], "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: r["escaped"] for r in chat.formatted(df).collect()} == {1: False, 2: True}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/x">menu one</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head&amp;line</h1><p>First <b>bold</b>text  with
 spaces &lt;tag&gt;<p>Second<script>var x="<p>no</p>";</script> one<!-- <p>hidden</p> --><ul><li>item<li>other</ul>
<div class="ad">Buy now</div><form><input value=1>Send</form><p>Last &eacute; words here.</p></article>
<section id="comments"><p>reader one says</p></section><footer>&copy; site</footer></body></html>"""


def test_main_text_of_pages(spark):
    pages = spark.createDataFrame(
        [(i, "u", PAGE.replace("First", f"First{i}")) for i in range(20)]
        + [(100, None, None), (101, "v", ""), (None, "w", "<p>only</p>"), (103, "x", "no tags & text"), (104, "y", "<" * 3000),
           (105, "z", "<div " * 500 + "a>words"), (106, "q", "<article>" + "<p>w " * 30000)], "page_id long, url string, html string")
    got = {(r["page_id"], r["url"]): r for r in html.extract(pages, html.learn(pages)).collect()}
    assert len(got) == 27
    for i in range(20):
        text = got[i, "u"]["text"]
        assert text.split("\n") == ["Head&line", f"First{i} boldtext with spaces <tag>", "Second one", "item", "other", "Last é words here."]
        assert got[i, "u"]["n_chars"] == len(text)
    assert got[100, None]["text"] == got[101, "v"]["text"] == ""
    assert got[None, "w"]["text"] == "only" and got[103, "x"]["text"] == "no tags & text"
    assert got[106, "q"]["n_chars"] == 2 * 30000 - 1
    assert html.extract(pages.where("false"), {}).collect() == []


@pytest.mark.parametrize(("page", "text"), [
    ('<article><div class="social-science"><p>Only words here</p></div></article>', "Only words here"),
    ('<body><div class="social-science"><p>Only words</p></div></body>', "Only words"),
    ('<article><h2 class="header">Title one</h2><p>see <a class="related" href=x>the paper</a> now.</p><div class="ad-slot">Buy</div></article>',
     "Title one\nsee the paper now."),
    ('<div class="cookie-notice">x</div><p>real text</p><div id="site-footer-2">foot</div>', "real text"),
])
def test_class_names_cut_whole_parts_only(page, text):
    assert html.main_text(page, {}) == text


def test_best_run_equals_all_runs():
    rng = random.Random(3)
    for _ in range(200):
        scores = [rng.randrange(-5, 6) for _ in range(rng.randrange(0, 12))]
        a, b = html.best_run(scores)
        sums = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)]
        assert sum(scores[a:b]) == max([0, *sums])


def items():
    rng = random.Random(8)
    words = [f"t{k}" for k in range(300)]
    return [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60))) + ". " + " ".join(rng.choices(words, k=5)) + ".")
            for i in range(40)]


def test_search_finds_all_items_above_the_threshold():
    """Block-max WAND against a plain sum over all postings."""
    told = items()
    frequency = {}
    for _, text in told:
        for h in set(decontaminate._hash(text).tolist()):
            frequency[h] = frequency.get(h, 0) + 1
    index = decontaminate.Index(told, frequency, len(told), 20.0)
    rng = random.Random(1)
    for _ in range(100):
        terms = sorted(rng.sample(range(len(index.terms)), rng.randrange(0, 150)))
        least = rng.choice([0.05, 0.2, 0.5])
        scores = {}
        for t in terms:
            for item, w in zip(index.postings[t][0], index.postings[t][1]):
                scores[item] = scores.get(item, 0.0) + w
        want = {i: s for i, s in scores.items() if s >= least - 1e-9}
        assert dict(index.search(terms, least)) == pytest.approx(want)


@pytest.mark.parametrize("max_words", [10**6, 300])
def test_leaks_of_planted_items(spark, table, odd, empty, max_words):
    told = items()
    bench = spark.createDataFrame([*told, (99, None), (None, "t1 t2"), (3, "again t5 t6 t7. t8")], "item_id long, text string")
    rng = random.Random(6)
    filler = [f"t{k}" for k in range(300)] + [f"f{k}" for k in range(2000)]
    rows, want = [], set()
    for i in range(120):
        text = rng.choices(filler, k=rng.choice([3, 50, 400]))
        if i % 3 == 0:
            j = rng.randrange(len(told))
            place = rng.randrange(len(text))
            text[place:place] = [told[j][1].upper() if i % 2 else told[j][1]]
            want.add((i, j))
        rows.append((i, " ".join(text)))
    docs = table(rows)
    got = decontaminate.leaks(docs, bench, max_words=max_words).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(r["question_overlap"] == r["answer_overlap"] == 1.0 for r in got)
    kept = decontaminate.clean(docs, bench, max_words=max_words)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.leaks(odd, bench).collect() == [] and decontaminate.leaks(empty, bench).collect() == []
    assert decontaminate.leaks(docs, bench.where("false")).collect() == []
    assert decontaminate.clean(odd, bench).count() == len(ODD)


@pytest.mark.parametrize(("edit", "least"), [("whole", 1.0), ("one word", 0.9), ("answer word", 0.9), ("no answer", 0.7)])
def test_recall_of_edited_items(edit, least):
    """Every item of the given benchmark between other words, whole or changed; documents without an item stay clean."""
    told = duckdb.sql("select item_id, text from '/root/testdata/sf0.001/benchmark.parquet'").fetchall()
    frequency = Counter(h for _, text in told for h in set(decontaminate._hash(text).tolist()))
    index = decontaminate.Index(told, frequency, len(told), sum(len(decontaminate._hash(t)) for _, t in told) / len(told))
    rng = random.Random(1)
    filler = [w for _, text in told for w in text.split()]
    found = 0
    for item, text in told:
        each, (question, answer) = text.split(), decontaminate.question_answer(text)
        if edit == "one word":
            each[rng.randrange(len(each))] = "changed"
        elif edit == "answer word":
            last = answer.split()
            last[rng.randrange(len(last))] = "changed"
            each = [question, *last]
        elif edit == "no answer":
            each = [question]
        around = rng.choices(filler, k=80)
        assert index.leaks(decontaminate._hash(" ".join(around)), decontaminate.SHARE, decontaminate.OVERLAP) == {}
        got = index.leaks(decontaminate._hash(" ".join([*around[:40], *each, *around[40:]])), decontaminate.SHARE, decontaminate.OVERLAP)
        found += item in {index.ids[k] for k in got}
    assert found >= least * len(told)


def test_mixture_keeps_budgets(spark, table, odd, empty):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 30)), rng.choice(["en", "de", None]), rng.choice(["src0"] * 6 + ["src1", "src2", None]))
            for i in range(900)]
    domain = F.when(F.col("source") == "src0", "a").when(F.col("source") == "src1", "b").otherwise("c")
    out = mixing.mixture(table(rows), domain, {"a": 1, "b": 3, "c": 1}, {"en": 3, "de": 1}, {}, share=(1, 2), epochs=2, seed=4).collect()
    size = {r[0]: len(r[1].split()) for r in rows}
    total = sum(size.values()) // 2
    taken = sum(r["n_tokens"] for r in out)
    assert total - 30 * 8 <= taken <= total
    assert all(r["n_tokens"] == size[r["doc_id"]] for r in out)
    assert len({(r["doc_id"], r["epoch"]) for r in out}) == len(out) and {r["epoch"] for r in out} <= {1, 2}
    # domain b cannot give three fifths even with two epochs, so it gives all, and a and c share the rest evenly
    b = sum(size[r[0]] for r in rows if r[3] == "src1")
    shares = {d: sum(r["n_tokens"] for r in out if r["domain"] == d) for d in "abc"}
    assert shares["b"] == 2 * b and abs(shares["a"] - shares["c"]) <= 30 * 8
    assert mixing.mixture(odd, F.lit("x"), {}, {}, {}, share=(1, 1)).count() >= 8
    assert mixing.mixture(empty, F.lit("x"), {}, {}, {}).collect() == []
    again = mixing.mixture(table(rows, 7), domain, {"a": 1, "b": 3, "c": 1}, {"en": 3, "de": 1}, {}, share=(1, 2), epochs=2, seed=4).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


START = datetime(2024, 1, 1)


def record(i, kind, url, hours, head="", body=None, status="200 OK"):
    top = "\r\n".join([f"HTTP/1.1 {status}", *filter(None, head.split("|"))]) + "\r\n\r\n"
    return (f"urn:{i}", kind, url, START + timedelta(hours=hours), None, top + (body or ""))


RECORDS = "record_id string, type string, url string, date timestamp, extra array<string>, block string"


def archive(spark, rows):
    path = new_path(spark, "test-warc")
    warc.write(spark.createDataFrame(rows, RECORDS).repartition(2), path)
    return warc.read(spark, path)


def test_warc_comes_back_whole(spark):
    bodies = ["", "plain", "é漢\U0001f600", "a\r\n\r\nb", "x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\nfake", "\r\n\r\n" * 3, "y" * 200_000]
    rows = [record(i, "response", f"http://h/{i}", i, "A: 1|B:  two ", b) for i, b in enumerate(bodies)]
    rows.append(("urn:info", "warcinfo", None, START, ["X-More: z"], "software: test"))
    got = {r["record_id"]: r for r in archive(spark, rows).collect()}
    assert len(got) == len(rows)
    for i, b in enumerate(bodies):
        r = got[f"urn:{i}"]
        assert bytes(r["body"]).decode() == b and r["http_status"] == 200 and r["url"] == f"http://h/{i}"
        assert [tuple(f) for f in r["http"]] == [("a", "1"), ("b", "two")]
    assert bytes(got["urn:info"]["body"]) == b"software: test" and got["urn:info"]["url"] is None


def test_revisits_take_the_latest_earlier_response(spark):
    rng = random.Random(9)
    rows, n = [], 0
    for url in ["http://Hot.example/a/", "https://www.hot.example/a", "http://b.example/?b=2&utm_source=x&a=1", "https://b.example?a=1&b=2#f"]:
        for _ in range(60):
            tag = rng.choice(["ETag: 1", "ETag: W/1", "ETag: 2", "Last-Modified: m", ""])
            if rng.random() < 0.3:
                rows.append(record(f"{n:04}", "response", url, rng.randrange(50), tag + "|Content-Type: t|Age: 1", f"body {n}"))
            else:
                rows.append(record(f"{n:04}", "revisit", url, rng.randrange(50), tag + "|Content-Type: u|Age: 2|Connection: x", status="304 Not Modified"))
            n += 1
    rows += [record("none", "revisit", None, 1, status="304 Not Modified"), record("alone", "revisit", "http://c/", 1, status="304 Not Modified"),
             record("failed", "response", "http://c/", 0, status="500 Error")]
    rows.append(rows[0])
    df = archive(spark, rows)
    got = {r["record_id"]: r for r in warc.resolve(df).collect()}

    def key(url):
        return "hot" if "ot." in url else "b"

    def tag(block):
        head = dict(x.split(": ", 1) for x in block.split("\r\n")[1:] if ": " in x)
        return head.get("ETag", "").removeprefix("W/") or None, head.get("Last-Modified")

    revisits = [r for r in rows if r[1] == "revisit" and r[2] and "c/" not in r[2]]
    for r in revisits:
        earlier = [q for q in rows if q[1] == "response" and "c/" not in q[2] and key(q[2]) == key(r[2]) and q[3] < r[3]]
        found = got[r[0]]
        if not earlier:
            assert found["outcome"] == "no base"
            continue
        best = max(earlier, key=lambda q: (q[3], q[0]))
        (e1, m1), (e2, m2) = tag(best[5]), tag(r[5])
        want = ("etag" if e1 == e2 else "conflict") if e1 and e2 else ("last-modified" if m1 == m2 else "conflict") if m1 and m2 else "unverified"
        assert found["outcome"] == want
        assert found["base_id"] == (best[0] if want in ("etag", "last-modified") else None)
        if found["base_id"]:
            http = dict(map(tuple, found["http"]))
            assert (http["content-type"], http["age"]) == ("t", "2") and "connection" not in http
    assert len(got) == len({r[0] for r in rows if r[1] == "revisit"})
    assert (got["urn:none"]["outcome"], got["urn:alone"]["outcome"]) == ("no url", "no base")
    assert warc.resolve(df.where("false")).collect() == []


def test_records_without_an_id_are_kept(spark):
    df = spark.createDataFrame(
        [(i, k, "http://a/x", START + timedelta(hours=h), s, [("etag", "1")], bytearray(b), b.decode()) for i, k, h, s, b in (
            (None, "response", 0, 200, b"first"), (None, "revisit", 1, 304, b""), (None, "revisit", 2, 304, b""), ("r", "revisit", 4, 304, b""),
            ("r", "revisit", 3, 304, b""))],
        "record_id string, type string, url string, date timestamp, http_status int, http array<struct<name:string,value:string>>, "
        "body binary, extra string")
    got = sorted(((r["record_id"] or "", r["date"].hour, r["outcome"], r["base_id"], r["payload_bytes"]) for r in warc.resolve(df).collect()))
    assert got == [("", 1, "etag", None, 5), ("", 2, "etag", None, 5), ("r", 3, "etag", None, 5)]
