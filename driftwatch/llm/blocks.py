"""Long arrays in blocks, in DataFrame functions only: running sums, cuts of a text and overlaps without quadratic work.

An array column has no running sum, and a place in a text is found by walking to it. So each of these works on blocks of BLOCK
elements and then on the blocks, which makes the work for n elements n * BLOCK + (n / BLOCK) ** 2 at most instead of n ** 2.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for which value is computed once for each row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def blocks(values: Column) -> Column:
    """The array cut into arrays of BLOCK elements; an empty one gives one empty block."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(BLOCK))
    return F.transform(starts, lambda k: F.slice(values, k + 1, F.lit(BLOCK)))


def _add(a: Column, b: Column) -> Column:
    return a + b


def _short_scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all"))

    def step(acc, x):
        return let(op(acc["at"], x), lambda at: F.struct(at.alias("at"), F.concat(acc["all"], F.array(at)).alias("all")))

    return F.aggregate(values, start, step)["all"]


def scan(values: Column, op: Callable[[Column, Column], Column] = _add) -> Column:
    """Running results of `op`, a sum or F.greatest, over an array of numbers of at least 0, each with its own element."""
    def whole(parts):
        last = F.transform(parts, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0).cast("bigint")))
        before = F.concat(F.array(F.lit(0).cast("bigint")), F.slice(_short_scan(last, op), F.lit(1), F.size(parts) - 1))
        return F.flatten(F.zip_with(parts, before, lambda p, b: F.transform(p, lambda x: op(x, b))))

    longs = values.cast("array<bigint>")
    return let(longs, lambda v: let(F.transform(blocks(v), lambda p: _short_scan(p, op)), whole))


def with_piece(text: Column, spans: Column, around: int, use: Callable[[Column, Column, Column], Column]) -> Column:
    """use(span, piece, shift) of every span (start, end) of `text`, in order.

    `piece` is the part of the text that holds the spans of one block with `around` code points on both sides (fewer at an end of the
    text); it begins at the code point `shift`. Spans in the order of their starts keep the pieces short; any order is right.
    """
    def one(part):
        first = F.greatest(F.array_min(F.transform(part, lambda s: s["start"])) - around, F.lit(0)).cast("int")
        size = (F.array_max(F.transform(part, lambda s: s["end"])) + around - first).cast("int")
        return let(first, lambda at: let(F.substring(text, at + 1, size), lambda piece: F.transform(
            part, lambda s: use(s, piece, at))))

    return let(spans, lambda all_spans: F.flatten(F.transform(F.filter(blocks(all_spans), lambda p: F.size(p) > 0), one)))


def cut(text: Column, spans: Column) -> Column:
    """The parts of `text` under spans (start, end), code points, end exclusive."""
    return with_piece(text, spans, 0, lambda s, piece, at: F.substring(
        piece, (s["start"] - at + 1).cast("int"), (s["end"] - s["start"]).cast("int")))


def _bounded(part: Column) -> Column:
    return F.struct(F.array_min(F.transform(part, lambda s: s["start"])).alias("start"),
                    F.array_max(F.transform(part, lambda s: s["end"])).alias("end"), part.alias("part"))


def _meet(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def apart(spans: Column, others: Column) -> Column:
    """The spans (start, end) that overlap none of `others`, in the order of the structs; blocks are compared before their members."""
    def bounded(values):
        return let(F.sort_array(values), lambda v: F.transform(F.filter(blocks(v), lambda p: F.size(p) > 0), _bounded))

    def one(block, rest):
        near = F.flatten(F.transform(F.filter(rest, lambda r: _meet(r, block)), lambda r: F.filter(r["part"], lambda o: _meet(o, block))))
        return let(near, lambda some: F.filter(block["part"], lambda s: ~F.exists(some, lambda o: _meet(o, s))))

    return F.when(F.size(others) == 0, spans).otherwise(
        let(bounded(others), lambda rest: F.flatten(F.transform(bounded(spans), lambda block: one(block, rest)))))
