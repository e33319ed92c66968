"""Long repeats across documents: run-length positional Burrows-Wheeler transforms of the places where texts may agree.

One transform of a whole corpus would need one machine. But a string of `length` bytes always holds a gram of K bytes with the smallest hash
in it, its anchor, wherever the string stands. So only texts around equal anchors can agree, and each anchor's contexts (all strings that have it as their anchor
lie inside) are indexed apart. Contexts that occur more than once settle all their strings by counting. The different contexts of an anchor
are laid below each other, aligned at the anchor, and transformed column by column (positional BWT): rows are sorted by what they have read
so far, and each keeps where its agreement with its neighbour began. Inside a run of equal symbols of the transform that stays as it was; only at the sampled run ends
it is computed anew. These matching statistics stream along the columns, and every agreement of `length` bytes or more is marked.

An anchor with very many different contexts is divided: half of the places at which a string may start before the anchor, by the bytes that all strings of
this half share; parts that nobody shares drop out, and equal contexts of a part again settle by counting.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm import words
from driftwatch.llm.words import mix
from driftwatch.storage import stage

GRAM = 32  # bytes of an anchor
SEGMENT = 1 << 21  # bytes of one text that are hashed at once
TAKEN = 1 << 23  # bytes of texts that are taken out of a batch at once
PLACES = 24  # bits of a place within what is hashed at once
CONTEXTS = 4096  # different contexts of an anchor that are transformed together; more are divided
HELD = 8192  # contexts of several anchors that are transformed together
ID_CLASSES = 1 << 21  # of the filters on documents, whatever their number
_rng = np.random.default_rng(400)
_BYTE = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64) | np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(b, -1, 2**64) for b in _BASES)


def _segments(texts, length):
    """(document, from, to, first start, last start + 1) of slices of the texts, which overlap as far as contexts reach."""
    for k, text in enumerate(texts):
        n = len(text)
        for a in range(0, max(0, n - length + 1), SEGMENT):
            b = min(a + SEGMENT, n - length + 1)
            yield k, max(0, a - length), min(n, b + 2 * length), a, b


def _blocks(segments):
    held, size = [], 0
    for s in segments:
        if held and size + s[2] - s[1] > words.BLOCK:
            yield held
            held, size = [], 0
        held.append(s)
        size += s[2] - s[1]
    if held:
        yield held


def _window_minima(x, width):
    """The smallest of x[i : i + width] for every i."""
    n = len(x) - width + 1
    padded = np.concatenate((x, np.full(-len(x) % width, x.max(), x.dtype))).reshape(-1, width)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def anchors(texts, length):
    """Columns (document, place, last, left, right, key, c1, c2, n) of the anchors of all strings of `length` bytes.

    left and right are how far the context reaches; neighbouring anchors of equal contexts are one row with their first and last place and number.
    """
    gram = min(GRAM, length)
    width = length - gram + 1
    for block in _blocks(_segments(texts, length)):
        joined = np.frombuffer(b"".join(texts[k][a:b] for k, a, b, _, _ in block), np.uint8)
        docs, starts, ends, first, stop = (np.array(c, np.int64) for c in zip(*block, strict=True))
        at = np.concatenate(([0], np.cumsum(ends - starts)[:-1]))  # where each segment begins
        n = len(joined)
        sums, powers = [], []
        for table, base, inverse in zip(_BYTE, _BASES, _INVERSES, strict=True):
            run = table[joined]
            run *= words._power(base, n)
            sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(run, dtype=np.uint64))))
            powers.append(words._power(inverse, n))
        hashes = mix((sums[0][gram:] - sums[0][: n - gram + 1]) * powers[0][: n - gram + 1])
        # the leftmost of the smallest: the place decides among equal hashes
        placed = (hashes >> np.uint64(PLACES) << np.uint64(PLACES)) | np.arange(len(hashes), dtype=np.uint64)
        least = (_window_minima(placed, width) & np.uint64((1 << PLACES) - 1)).astype(np.int64)
        place = np.concatenate([least[o + f - s : o + e - s] for o, s, f, e in zip(at, starts, first, stop, strict=True)])
        place = place[np.r_[True, place[1:] != place[:-1]]]
        segment = np.searchsorted(at, place, side="right") - 1
        own = place - at[segment] + starts[segment]
        sizes = np.array([len(texts[k]) for k in docs], np.int64)[segment]
        left, right = np.minimum(length - gram, own), np.minimum(length, sizes - own)
        c1, c2 = (mix((s[place + right] - s[place - left]) * p[place - left] + (left * 1024 + right).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                  for s, p in zip(sums, powers, strict=True))
        # the anchor at the cut of a long text belongs to both of its segments
        yield docs[segment], own, left, right, hashes[place], c1, c2


def _parts(batch):
    """Slices of a batch with at most about TAKEN bytes of texts each."""
    sizes = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + TAKEN, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _anchor_rows(length):
    def run(batches):
        for batch in (part for whole in batches for part in _parts(whole)):
            texts = batch.column(2).to_pylist()
            found = list(anchors(texts, length))
            if not found:
                continue
            doc, own, left, right, key, c1, c2 = map(np.concatenate, zip(*found, strict=True))
            again = (doc[1:] == doc[:-1]) & (own[1:] == own[:-1])
            keep = np.r_[True, ~again]
            doc, own, left, right, key, c1, c2 = (x[keep] for x in (doc, own, left, right, key, c1, c2))
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])])
            count = np.diff(np.r_[new, len(doc)])
            last = own[new + count - 1]
            ids, shas = (batch.column(k).take(pa.array(doc[new])) for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [ids, shas, *(pa.array(x[new].view(np.int64)) for x in (own,)), pa.array(last), pa.array(left[new].astype(np.int32)),
                 pa.array(right[new].astype(np.int32)), *(pa.array(x[new].view(np.int64)) for x in (key, c1, c2)), pa.array(count.astype(np.int64))],
                ["doc_id", "h", "place", "last", "left", "right", "key", "c1", "c2", "n"])
    return run


def long_matches(symbols, given, group, length):
    """Which strings of `length` columns of each row also stand in another row of its group, at the same columns.

    symbols (rows x columns) with `given` telling where a row has a symbol; rows of a group lie together. The positional transform is
    built column by column; `begin` holds where the agreement of each row with the one above it began.
    """
    m, columns = symbols.shape
    marks = np.zeros((m, max(0, columns - length + 1)), bool)
    order, begin = np.arange(m), np.zeros(m, np.int64)
    base = group * (256 + m)
    begin[np.r_[True, group[1:] != group[:-1]]] = columns + 1
    for column in range(columns):
        here = order
        symbol = np.where(given[here, column], symbols[here, column].astype(np.int64), 256 + here)  # what is not given differs from everything
        key = base[here] + symbol
        place = np.argsort(key, kind="stable")
        order, sorted_key = here[place], key[place]
        same = np.r_[False, sorted_key[1:] == sorted_key[:-1]]
        new = np.where(same, begin[place], column + 1)
        ends = np.flatnonzero(same & (np.r_[0, np.diff(place)] != 1))  # heads of runs: rows between had another symbol
        if len(ends):
            low, high = place[ends - 1] + 1, place[ends]
            levels = (high - low + 1).astype(np.int64)
            top = int(levels.max()).bit_length()
            maxima, answer = begin, np.zeros(len(ends), np.int64)
            for k in range(top):
                fit = (levels >> k == 1)
                if fit.any():
                    answer[fit] = np.maximum(maxima[low[fit]], maxima[high[fit] - (1 << k) + 1])
                step = 1 << k
                maxima = np.concatenate((np.maximum(maxima[:-step], maxima[step:]), maxima[-step:])) if step < m else maxima
            new[ends] = answer
        begin = new
        if column + 1 >= length:
            long = np.flatnonzero(column + 1 - begin >= length)
            marks[order[long], column + 1 - length] = True
            marks[order[long - 1], column + 1 - length] = True
    return marks


def _transformed(length):
    """Spans of the single contexts (bucket, n, doc_id, h, place, left, right, low, high, s), which come bucket by bucket."""
    reach = length - min(GRAM, length)

    def spans(rows):
        bucket, n, ids, hashes, place, left, right, text = (list(x) for x in zip(*rows, strict=True))
        group = np.unique(np.array(bucket), return_inverse=True)[1]
        order = np.argsort(group, kind="stable")
        left, right, place, n = (np.array(x, np.int64) for x in (left, right, place, n))
        columns = np.arange(reach + length)
        given = (columns >= (reach - left)[:, None]) & (columns < (reach + right)[:, None])
        symbols = np.zeros(given.shape, np.uint8)
        symbols[given] = np.frombuffer(b"".join(text), np.uint8)
        marks = np.zeros((len(rows), reach + 1), np.int8)
        marks[order] = long_matches(symbols[order], given[order], group[order], length)
        marks[n > 1] = 0  # all their strings are known to repeat
        edge = np.diff(np.pad(marks, ((0, 0), (1, 1))), axis=1)
        (row, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        start = place[row] + a - reach
        return pa.RecordBatch.from_arrays(
            [pa.array([ids[r] for r in row], pa.int64()), pa.array([hashes[r] for r in row], pa.int64()),
             pa.array(start), pa.array(start + b - a - 1 + length)], ["doc_id", "h", "a", "b"])

    def run(batches):
        held = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if len(held) >= HELD and row[0] != held[-1][0]:
                    yield spans(held)
                    held = []
                held.append(row)
        if held:
            yield spans(held)
    return run


def _settled(rows: DataFrame, context: list[str], keep: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose context occurs more than once, and one row of each context of the anchors (key) that have several, some of them single."""
    counts = stage(rows.groupBy(*context).agg(F.sum("n").alias("n"), F.min(F.struct(*keep)).alias("r")), name)
    often = rows.drop("n").join(counts.where("n > 1").select(*context), context, "left_semi")
    several = counts.groupBy("key").agg(F.count("*").alias("contexts"), F.min("n").alias("fewest")).where("contexts > 1 and fewest = 1")
    return often, counts.join(several.select("key", "contexts"), "key").select("key", "contexts", "n", "r.*")


def _kind():
    return F.pmod(F.xxhash64("doc_id", "h"), F.lit(ID_CLASSES)).alias("kind")


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, h, spans): the spans [a, b) of bytes of every text that are covered by strings of `length` bytes which also start elsewhere.

    h is xxhash64 of the text (null: empty). Only texts with spans are returned; spans may overlap. Contexts count as equal by 128 bits of hash.
    """
    reach = length - min(GRAM, length)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("b"))
    found = stage(texts.where(F.octet_length("b") >= length).mapInArrow(
        _anchor_rows(length), "doc_id long, h long, place long, last long, left int, right int, key long, c1 long, c2 long, n long"), "anchors")
    often, mixed = _settled(found, ["key", "c1", "c2"], ["doc_id", "h", "place", "left", "right"], "contexts")
    spans = [often.select("doc_id", "h", (F.col("place") - F.col("left")).alias("a"), (F.col("last") + F.col("right")).alias("b"))]

    wanted = mixed.groupBy("doc_id", "h").agg(F.collect_list(F.struct("key", "contexts", "n", "place", "left", "right")).alias("r"))
    wanted = stage(wanted, "wanted-contexts")
    some = texts.withColumn("kind", _kind()).join(F.broadcast(wanted.select(_kind()).distinct()), "kind", "left_semi")
    same = some["doc_id"].eqNullSafe(wanted["doc_id"]) & (some["h"] == wanted["h"])
    pieces = some.join(wanted, same).select(some["doc_id"], some["h"], F.explode(F.expr(
        "transform(r, x -> struct(x.key, x.contexts, x.n, x.place, x.left, x.right,"
        " substring(b, int(x.place - x.left) + 1, x.left + x.right) as s))")).alias("x")).select("doc_id", "h", "x.*")
    level = stage(pieces.select(F.hex("key").alias("key"), "contexts", "n", "doc_id", "h", "place", "left", "right",
                                F.lit(0).alias("low"), F.lit(reach).alias("high"), "s"), "context-texts")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        few = level.where(F.col("contexts") <= CONTEXTS).select("key", "n", "doc_id", "h", "place", "left", "right", "s")
        spans.append(few.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(
            _transformed(length), "doc_id long, h long, a long, b long"))
        many = level.where(F.col("contexts") > CONTEXTS)
        if many.isEmpty():
            break
        # strings that start low..high bytes before the anchor, in two halves
        half = F.expr("(low + high) div 2").cast("int")
        each = many.withColumn("ends", F.explode(F.array(F.struct(F.col("low").alias("low"), half.alias("high")), F.struct(
            (half + 1).alias("low"), F.col("high").alias("high"))))).select(
            "key", "n", "doc_id", "h", "place", "left", "right", "s", "ends.low", "ends.high")
        first, last = F.greatest("low", F.lit(length) - F.col("right")), F.least("high", "left")
        each = each.withColumns({"first": first, "final": last}).where("first <= final")
        shared = F.expr(f"substring(s, left - low + 1, {length} - high + low)")
        context = F.expr(f"substring(s, left - final + 1, {length} - first + final)")
        each = stage(each.select(F.concat_ws(":", F.md5(F.concat(F.col("key").cast("binary"), shared)), "low", "high").alias("key"), "n", "doc_id", "h",
                                 "place", "left", "right", "low", "high", "first", "final", "s",
                                 F.concat_ws(":", F.md5(context), "first", "final").alias("c")), "divided")
        often, mixed = _settled(each, ["key", "c"], ["doc_id", "h", "place", "left", "right", "low", "high", "s"], "divided-contexts")
        spans.append(often.select("doc_id", "h", (F.col("place") - F.col("final")).alias("a"), (F.col("place") + length - F.col("first")).alias("b")))
        level = stage(mixed, "context-texts")
    out = spans[0]
    for more in spans[1:]:
        out = out.union(more)
    return out.groupBy("doc_id", "h").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _cut(batches):
    """Merge the spans of every text and take them out."""
    for batch in batches:
        kept, merged = [], []
        for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            text, out, parts, at = text.as_py(), [], [], 0
            for a, b in sorted((s["a"], s["b"]) for s in spans):
                if out and a <= out[-1]["b"]:
                    out[-1]["b"] = max(out[-1]["b"], b)
                else:
                    out.append({"a": a, "b": b})
            for s in out:
                parts.append(text[at : s["a"]])
                at = s["b"]
            kept.append(b"".join([*parts, text[at:]]))
            merged.append(out)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.binary()), pa.array(
            merged, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], ["doc_id", "b", "kept", "spans"])


def without_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_bytes, kept (binary), spans (removed, maximal and in order).

    Every byte goes that is covered by a string of `length` bytes which also starts at another place, of the same text or another; matches never cross
    documents and are judged on the input. Null texts are empty. Rows that repeat a text are copies of each other, also under one doc_id
    or none. Other columns do not matter; an empty table gives an empty result.
    """
    spans = stage(repeated_spans(docs, length), "repeats")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("b"))
    texts = texts.withColumn("kind", _kind())
    kinds = F.broadcast(spans.select(_kind()).distinct())
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    clean = texts.join(kinds, "kind", "left_anti").select("doc_id", "b", F.col("b").alias("kept"), none.alias("spans"))
    other = texts.join(kinds, "kind", "left_semi")
    same = other["doc_id"].eqNullSafe(spans["doc_id"]) & (other["h"] == spans["h"])
    cut = other.join(spans, same, "left").select(other["doc_id"], "b", F.coalesce("spans", none).alias("spans")).mapInArrow(
        _cut, "doc_id long, b binary, kept binary, spans array<struct<a:bigint,b:bigint>>")
    return clean.union(cut).select("doc_id", F.octet_length("b").cast("long").alias("n_bytes"), "kept", "spans")
