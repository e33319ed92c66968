"""Personal data in texts, in DataFrame functions only.

Strict patterns give the base spans, which always stay. Loose generators propose more spans, which may overlap; boosted
trees score them by format and context, and thresholds calibrated on a held-out third of the documents select those that are added.
Examples for both are candidates beside the base spans, as they are what can be added: disguised rewritings of base spans, look-alikes
made from them, and bare or glued candidates of the texts.
All documents give examples. Equal ones, of which there are many as their features are small whole numbers, are counted before the
trees are fitted, so that the fit grows with the different examples only.
The trees are fitted by Spark and compiled into one column expression over the candidates of a document, so that spans need no
shuffle: every document is handled in its own row.
"""

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.blocks import apart, cut, let, scan, with_piece
from driftwatch.storage import stage

KINDS = ("email", "ip", "card", "phone")
# fixed values: the base patterns. Loops are possessive and starts are tied to the start of a run of characters or to the
# end of the match before, which finds the same spans in linear time and without recursion
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# characters without which a pattern has no match
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+",
    "ip": r"(?:\G|(?<![0-9.]))[0-9]{1,3}(?:[.:][0-9]{1,3}){2,5}+",
    "card": r"[0-9](?:[\x20.-]?[0-9])++",
    "phone": r"[+(]?[0-9][0-9().\x20-]*[0-9]",
}
LEAST_DIGITS = {"email": 0, "ip": 4, "card": 12, "phone": 8}  # of a proposed span
CUES = {"email": "mail|contact", "ip": r"\bip\b|host|server|address", "card": "card|visa|credit|account|iban",
        "phone": "phone|tel|call|mobile|fax"}
# words before a number that is no personal datum
DENIES = r"\b(?:order|invoice|ticket|item|version|serial|batch|build|article|page|total|ref|isbn)\b"
CONTEXT = 24  # characters before a span that are searched for cues
AROUND = 40  # characters kept on both sides of a rewritten span
FEATURES = ["kind", "size", "digits", "letters", "ats", "dots", "dashes", "spaces", "brackets", "plus", "groups", "longest",
            "luhn", "small", "cue", "denied", "domain", "joined_before", "joined_after"]
TREES, DEPTH = 20, 4
PRECISION, LEAST_SCORE = 0.98, 0.5  # of added spans on the held-out part, and the score that one needs in any case


def _spans(text: Column, pattern: str, keep) -> Column:
    """Matches of a pattern as structs (start, end, match) in code points, those for which keep(match) holds."""
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def placed(found):
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = scan(F.zip_with(between, found, lambda gap, match: F.length(gap) + F.length(match)))
        spans = F.zip_with(found, ends, lambda match, end: F.struct(
            (end - F.length(match)).cast("int").alias("start"), end.cast("int").alias("end"), match.alias("match")))
        return F.when(F.size(found) == 0, none).otherwise(F.filter(spans, lambda s: keep(s["match"])))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: str):
    if kind == "ip":
        return lambda m: F.forall(F.split(m, r"\."), lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return lambda m: F.length(_digits(m)).between(14, 19) & F.coalesce(F.call_function("luhn_check", _digits(m)), F.lit(False))
    if kind == "phone":
        return lambda m: F.length(_digits(m)).between(10, 15)
    return lambda m: F.lit(True)


def _labelled(kind: str, spans: Column) -> Column:
    number = KINDS.index(kind)
    return F.transform(spans, lambda s: F.struct(s["start"], F.lit(number).alias("kind"), s["end"], s["match"]))


def base_spans(text: Column) -> Column:
    """Array of (start, kind number, end, match) of all strict matches, by start, then kind."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")
    parts = []
    for kind in KINDS:
        may = text.contains(NEEDS[kind]) if NEEDS[kind] else F.lit(True)
        may = may & text.rlike("[0-9]") if kind != "email" else may
        parts.append(F.when(may, _labelled(kind, _spans(text, STRICT[kind], _valid(kind)))).otherwise(none))
    return F.sort_array(F.concat(*parts))


def candidates(text: Column) -> Column:
    """Array of (start, kind number, end, match) that the loose generators propose; spans may overlap."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")
    parts = []
    for kind in KINDS:
        least = LEAST_DIGITS[kind]
        may = text.rlike(r"@|\(at\)|\[at\]") if kind == "email" else text.rlike("[0-9]")
        keep = (lambda m, n=least: F.length(_digits(m)) >= n) if least else (lambda m: F.lit(True))
        parts.append(F.when(may, _labelled(kind, _spans(text, LOOSE[kind], keep))).otherwise(none))
    return F.concat(*parts)


def _features(text: Column, span: Column, shift: Column) -> list[Column]:
    """The FEATURES of a span, as numbers; `text` is a part of its text that begins at the code point `shift`."""
    match, start, end = span["match"], span["start"] - shift, span["end"] - shift
    count = lambda what: F.length(F.regexp_replace(match, f"[^{what}]", ""))
    groups = F.filter(F.split(match, "[^0-9]+"), lambda g: g != "")
    before = F.lower(F.substring(text, F.greatest(start - CONTEXT + 1, F.lit(1)), F.least(start, F.lit(CONTEXT))))
    cue = denied = F.lit(False)
    for number, kind in enumerate(KINDS):
        cue = cue | ((span["kind"] == number) & before.rlike(CUES[kind]))
        denied = denied | ((span["kind"] == number) & before.rlike(f"(?s){DENIES}(?!.*(?:{CUES[kind]}))"))  # the last word counts
    luhn = F.coalesce(F.when(F.length(_digits(match)) > 1, F.call_function("luhn_check", _digits(match))), F.lit(False))
    small = F.forall(groups, lambda g: F.coalesce(g.try_cast("int") <= 255, F.lit(False)))
    edge = lambda at: F.substring(text, at, F.lit(1)).rlike("[A-Za-z0-9]")
    return [span["kind"], F.length(match), count("0-9"), count("A-Za-z"), count("@"), count("."), count(r"\-"), count(r"\x20"),
            count("()"), count("+"), F.size(groups), F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), luhn, small,
            cue, denied, match.rlike(r"\.[A-Za-z]{2,}$"), (start > 0) & edge(start), edge(end + 1)]


def _featured(text: Column, spans: Column) -> Column:
    return with_piece(text, spans, CONTEXT, lambda s, piece, shift: F.struct(
        s["start"], s["kind"].alias("number"), s["end"],
        *(c.cast("double").alias(n) for n, c in zip(FEATURES, _features(piece, s, shift), strict=True))))


def _with_featured(rows: DataFrame) -> DataFrame:
    """Add `featured`, the candidates of `text` with their features, in steps that the analyser can resolve one by one."""
    rows = rows.withColumn("proposed", candidates(F.col("text")))
    return rows.withColumn("featured", _featured(F.col("text"), F.col("proposed"))).drop("proposed")


def _tree(lines: list[str], at: int) -> tuple:
    """Read one node of Spark's description of a tree: ((feature, limit, left, right) or value, next line)."""
    m = re.match(r"\s*If \(feature (\d+) <= ([-+.\dEe]+)\)", lines[at])
    if not m:
        return float(re.match(r"\s*Predict: ([-+.\dEe]+)", lines[at])[1]), at + 1
    left, at = _tree(lines, at + 1)
    right, at = _tree(lines, at + 1)  # behind the line with Else
    return (int(m[1]), float(m[2]), left, right), at


def trees(model) -> list[tuple[tuple, float]]:
    return [(_tree([x for x in t.toDebugString.splitlines() if re.match(r"\s*(If|Else|Predict)", x)], 0)[0], w)
            for t, w in zip(model.trees, model.treeWeights, strict=True)]


def _node(node, features) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    feature, limit, left, right = node
    return F.when(features(feature) <= limit, _node(left, features)).otherwise(_node(right, features))


def score(fitted: list[tuple[tuple, float]], span: Column) -> Column:
    """Probability of a featured span, as one column expression."""
    total = F.lit(0.0)
    for tree, weight in fitted:
        total = total + weight * _node(tree, lambda k: span[FEATURES[k]])
    return 1 / (1 + F.exp(-2 * total))


def _pick(of: str, *options) -> Column:
    """One of the options, by a hash of the base span that an example is made from."""
    place = F.pmod(F.xxhash64(F.lit(of), "doc_id", "s.start", "s.match"), F.lit(len(options))) + 1
    return F.element_at(F.array(*(o if isinstance(o, Column) else F.lit(o) for o in options)), place.cast("int"))


def _checked(digits: Column, right: bool) -> Column:
    """The digits and a last one with which they pass the Luhn check, or the digit after that one."""
    last = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: F.call_function("luhn_check", F.concat(digits, d.cast("string"))))[0]
    return F.concat(digits, (last if right else F.pmod(last + 1, F.lit(10))).cast("string"))


def _made(kind: str) -> list[tuple[float, Column, Column]]:
    """Examples (label, words before, span) made from a base span `s`: disguised ones and look-alikes.

    What the form alone does not tell, such as a bare number, is personal behind a cue and not so behind another word.
    """
    match, digits = F.col("s.match"), _digits(F.col("s.match"))
    cues = {"email": (" email ", " contact: ", " mail to "), "ip": (" ip ", " host ", " server address "),
            "card": (" card ", " credit card: ", " visa "), "phone": (" phone ", " call ", " tel. ", " mobile: ")}[kind]
    cue = _pick("cue", *cues)
    maybe = _pick("maybe", "", *cues)
    denies = (" order ", " order number ", " invoice ", " version ", " ticket ", " item ", " serial ", " ref. ")
    deny = F.concat(_pick("mixed", "", "", cue), _pick("deny", *denies))
    if kind == "email":
        name, host = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
        letters = lambda c: F.concat(F.lit("m"), F.regexp_replace(c, "[0-9]", ""))
        name = _pick("name", name, letters(name), letters(F.regexp_replace(name, "[._-]", "")))
        host = _pick("host", host, F.substring_index(host, ".", -2), letters(F.substring_index(host, ".", -2)))
        mark = _pick("mark", " (at) ", "(at)", " [at] ", "[at]", " @ ")
        marks = _pick("marks", " (at) ", "(at)", " [at] ", " @ ", "@")
        place = _pick("place", "home", "noon", "work", "3", F.substring_index(host, ".", 1), F.regexp_replace(host, r"\.", "-"))
        return [(1.0, maybe, F.concat(name, mark, host)), (0.0, _pick("any", "", "", *cues), F.concat(name, marks, place))]
    if kind == "ip":
        parts = F.split(match, r"\.")
        clock = [F.lpad(F.pmod(parts[i].cast("int"), F.lit(n)).cast("string"), 2, "0") for i, n in enumerate((24, 60, 60))]
        first = F.concat_ws(".", *(parts[i] for i in range(3)))
        return [(1.0, maybe, _pick("ip", F.concat_ws(":", *(parts[i] for i in range(4))), F.concat(first, F.lit(":"), parts[3]))),
                (0.0, _pick("any", "", deny), _pick("other", F.concat_ws(":", *clock), first)),
                (0.0, deny, F.concat(first, F.lit(":"), (parts[3].cast("int") + 256).cast("string"))),
                (0.0, F.lit(""), F.concat_ws(":", *(parts[i] for i in (0, 1, 2, 3, 0))))]
    if kind == "card":
        fours = lambda c, mark: F.regexp_replace(c, "(.{4})(?=.)", f"$1{mark}")
        whole, wrong = digits, _checked(F.expr("left(regexp_replace(s.match, '[^0-9]', ''), 15)"), False)
        short = [F.substring(digits, 1, n) for n in (11, 12)]
        right = _pick("short", *(_checked(c, True) for c in short))
        return [(1.0, maybe, fours(whole, ".")),
                (1.0, cue, _pick("shape", right, fours(right, " "), fours(right, "-"))),
                (0.0, _pick("any", "", cue, deny), _pick("other", wrong, fours(wrong, "."), _checked(short[1], False))),
                (0.0, deny, right)]
    ten = F.expr("right(regexp_replace(s.match, '[^0-9]', ''), 10)")
    groups = [F.substring(ten, at, n) for at, n in ((1, 3), (4, 3), (7, 4))]
    shapes = [F.regexp_replace(match, r"^\+", ""), F.concat(F.lit("("), groups[0], F.lit(") "), groups[1], F.lit("-"), groups[2]),
              F.concat_ws(".", *groups), F.concat_ws("-", *groups)]
    date = F.concat(F.lit("20"), *(F.concat(sep, F.lpad((F.pmod(g.cast("int"), F.lit(n)) + 1).cast("string"), 2, "0"))
                                   for sep, g, n in zip((F.lit(""), F.lit("-"), F.lit("-")), groups, (29, 12, 28), strict=True)))
    bare = _pick("bare", ten, F.substring(ten, 1, 8), F.substring(ten, 1, 9), F.concat(F.lit("7"), ten))
    return [(1.0, maybe, _pick("shape", *shapes)), (1.0, cue, _pick("bare cue", ten, F.concat(F.lit("1"), ten))),
            (0.0, _pick("any", deny, ""), _pick("other", date, bare, bare)),
            (0.0, deny, _pick("denied", bare, F.concat(groups[0], F.lit("-"), groups[1], groups[2]), *shapes[1:]))]


def made_examples(rows: DataFrame) -> DataFrame:
    """(doc_id, label, number, FEATURES) of candidates in rewritten pieces of the texts of `rows` (doc_id, text, base).

    A base span is written anew with the text around it. The candidate of its kind and place gets the label of the
    rewriting, candidates of other kinds that overlap it are counterexamples; others, all that touch a base span, and disguised
    ones behind a word of the text that denies them do not count.
    """
    def cut_out(s, piece, shift):
        start, end = (s["start"] - shift).cast("int"), (s["end"] - shift).cast("int")
        left = F.substring(piece, F.greatest(start - AROUND + 1, F.lit(1)), F.least(s["start"], F.lit(AROUND)))
        return F.struct(s["start"], s["kind"], s["match"], left.alias("left"), F.substring(piece, end + 1, F.lit(AROUND)).alias("right"))

    spans = rows.withColumn("around", with_piece(F.col("text"), F.col("base"), AROUND, cut_out)).select(
        "doc_id", F.explode("around").alias("s"))
    none = F.array().cast("array<struct<label:double,words:string,span:string>>")
    made = none
    for number, kind in enumerate(KINDS):
        ways = F.array(*(F.struct(F.lit(label).alias("label"), words.alias("words"), span.alias("span")) for label, words, span in _made(kind)))
        made = F.when(F.col("s.kind") == number, ways).otherwise(made)
    pieces = spans.select("doc_id", F.col("s.kind").alias("kind"), "s.left", "s.right", F.explode(made).alias("m")).select(
        "doc_id", "kind", "m.label", (F.length("left") + F.length("m.words")).alias("start"), F.length("m.span").alias("size"),
        F.concat("left", "m.words", "m.span", "right").alias("text"))
    pieces = _with_featured(pieces.withColumn("base", base_spans(F.col("text"))))
    found = pieces.select("doc_id", "kind", "label", "start", (F.col("start") + F.col("size")).alias("end"),
                          "base", F.explode("featured").alias("x"))
    meant = (F.col("x.start") == F.col("start")) & (F.col("x.end") == F.col("end"))
    overlaps = (F.col("x.start") < F.col("end")) & (F.col("start") < F.col("x.end"))
    told = F.when((F.col("label") == 0) | (F.col("x.denied") == 0), F.col("label"))
    label = F.when(F.col("x.number") == F.col("kind"), F.when(meant, told)).when(overlaps, 0.0)
    return found.where(~_touched()).select("doc_id", label.alias("label"), "x.number", *(F.col(f"x.{n}") for n in FEATURES))


def _touched() -> Column:
    return F.exists("base", lambda b: (b["start"] < F.col("x.end")) & (F.col("x.start") < b["end"]))


def plain_examples(rows: DataFrame) -> DataFrame:
    """(doc_id, label, number, FEATURES) of candidates of the texts of `rows` that are surely counterexamples.

    These touch no base span and are glued to other letters or digits; or have no cue and either a word that denies them or no form of
    their kind (a domain, groups of digits as in a phone number, a right check digit, four small numbers). All others are
    unknown: they may be what is looked for, so nothing is learned from them.
    """
    free = rows.withColumn("proposed", candidates(F.col("text"))).withColumn("free", apart(F.col("proposed"), F.col("base")))
    found = free.withColumn("featured", _featured(F.col("text"), F.col("free"))).select("doc_id", F.explode("featured").alias("x"))
    form = {"email": F.col("x.domain") == 1, "ip": (F.col("x.groups") == 4) & (F.col("x.small") == 1), "card": F.col("x.luhn") == 1,
            "phone": F.col("x.groups").between(2, 5) & F.col("x.digits").between(10, 15)}
    shaped = F.lit(False)
    for number, kind in enumerate(KINDS):
        shaped = shaped | ((F.col("x.number") == number) & form[kind])
    glued = (F.col("x.joined_before") == 1) | (F.col("x.joined_after") == 1)
    sure = glued | ((F.col("x.cue") == 0) & ((F.col("x.denied") == 1) | ~shaped))
    return found.where(sure).select("doc_id", F.lit(0.0).alias("label"), "x.number", *(F.col(f"x.{n}") for n in FEATURES))


def counted_examples(docs: DataFrame) -> DataFrame:
    """(held, label, number, FEATURES, n): how often each example occurs in all `docs`, apart for the third of them that is held back."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    examples = made_examples(rows).where("label is not null").unionByName(plain_examples(rows))
    held = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(3)) == 0
    return examples.groupBy(held.alias("held"), "label", "number", *FEATURES).agg(F.count("*").cast("double").alias("n"))


def fit(docs: DataFrame) -> dict:
    """Trees and one threshold for each kind, from the candidates of all documents.

    Examples are candidates beside the base spans only, see `made_examples` and `plain_examples`. Two thirds of the
    documents (by hash) fit the trees, the rest sets the thresholds: the lowest one above which PRECISION is kept. A kind or a table without
    examples of both sorts adds nothing.
    """
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(stage(counted_examples(docs), "examples"))
    learn = vectors.where("not held")
    if learn.select("label").distinct().count() < 2:
        return {"trees": [], "thresholds": {}}
    # the same parts in the same order whenever it is fitted
    learn = learn.repartition(4, *FEATURES).sortWithinPartitions("label", *FEATURES).select("label", "n", "vector")
    model = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="n", maxIter=TREES, maxDepth=DEPTH, seed=5).fit(learn)
    scored = model.transform(vectors.where("held")).select(
        "number", "label", "n", F.floor(vector_to_array("probability")[1] * 100).alias("bin"))
    bins = scored.groupBy("number", "bin").agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).collect()
    thresholds = {}
    for number in range(len(KINDS)):
        good = n = 0.0
        counts = {r.bin: r for r in bins if r.number == number}
        for limit in range(100, round(100 * LEAST_SCORE) - 1, -1):
            if limit in counts:
                good, n = good + counts[limit].good, n + counts[limit].n
            if good and good >= PRECISION * n:
                thresholds[number] = limit / 100
    return {"trees": trees(model), "thresholds": thresholds}


def find(docs: DataFrame, model: dict) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, text, base, spans.

    `base` are the strict matches, `spans` these and the candidates that the model adds, which are those that touch no base span and
    reach the threshold of their kind; both are arrays of (start, kind, end) in code points, end exclusive, by start, then
    kind as in KINDS. A null or empty text has none. doc_id may be null or repeat; other columns do not matter; an empty table gives an empty
    result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    added = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    if model["trees"] and model["thresholds"]:
        # a step for each, since the analyser has a limit on how deep functions of arrays may lie in each other
        rows = rows.withColumn("proposed", candidates(F.col("text")))
        rows = rows.withColumn("free", apart(F.col("proposed"), F.col("base")))

        def enough(x):
            limit = F.lit(2.0)
            for number, threshold in model["thresholds"].items():
                limit = F.when(x["number"] == number, F.lit(threshold)).otherwise(limit)
            return score(model["trees"], x) >= limit

        added = F.when(F.size("free") > 0, F.transform(
            F.filter(_featured(F.col("text"), F.col("free")), enough),
            lambda x: F.struct(x["start"], x["number"].alias("kind"), x["end"]))).otherwise(added)
    plain = F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["end"]))
    # nothing repeats: added spans touch no base span, and those of one kind do not overlap
    return rows.withColumn("added", added).select(
        "doc_id", "text", plain.alias("base"), F.sort_array(F.concat(plain, "added")).alias("spans"))


def redact(found: DataFrame, mark: str = "*") -> DataFrame:
    """(doc_id, text) of `find` with every character of a span replaced by `mark`."""
    zero = F.array(F.lit(0).cast("bigint"))
    reach = F.concat(zero, scan(F.transform("spans", lambda s: s["end"]), F.greatest))  # up to here all is written before a span
    rows = found.withColumn("reach", reach)
    plain = F.zip_with("spans", F.slice("reach", F.lit(1), F.size("spans")), lambda s, at: F.struct(
        at.alias("start"), F.greatest(s["start"], at).alias("end"), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0)).alias("masked")))
    rows = rows.withColumn("plain", plain)
    pieces = F.zip_with(cut(F.col("text"), F.col("plain")), "plain", lambda piece, s: F.concat(
        piece, F.repeat(F.lit(mark), s["masked"].cast("int"))))
    rest = F.substring(F.col("text"), (F.element_at("reach", -1) + 1).cast("int"), F.length("text"))
    return rows.select("doc_id", F.concat(F.array_join(pieces, ""), rest).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, and both span lists as text."""
    name = F.array(*map(F.lit, KINDS))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(
        ":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(number):
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
