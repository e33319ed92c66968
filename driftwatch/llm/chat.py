"""Chat formatting as a grammar round trip, in DataFrame functions only.

A turn is written as an opening control string, a space, the text, a space and a closing control string. The rendered
text is read back by a deterministic parser, which cuts it at every control string; if the turns it finds are not the
source's, the texts are escaped and rendered again. The escape puts one backslash after the first character of every
control string in a text, also of those that have backslashes there already, so that it can be undone exactly and an
escaped text holds no control string.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.blocks import cut, scan

# fixed values: the control strings of the template
OPEN = {"system": "[SYS]", "user": "[INST]", "assistant": "[OUT]"}
CLOSE = {"system": "[/SYS]", "user": "[/INST]", "assistant": "</s>"}
OTHER_OPEN, OTHER_CLOSE = "[ROLE]", "[/ROLE]"
CONTROL = r"(?:\[/?(?:SYS|INST|ROLE)\]|\[OUT\]|</s>)"
BODY = r"(/?(?:SYS|INST|ROLE)\]|OUT\]|/s>)"  # what follows the first character of a control string


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])(\\*)" + BODY, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])\\(\\*)" + BODY, "$1$2$3")


def _mark(role: Column, marks: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for name, mark in marks.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def render(turns: Column, escaped: bool) -> Column:
    """The text of an array of turns (role, text)."""
    def one(turn):
        role, text = turn["role"], turn["text"]
        # a role of another name travels in front of its text, with its length, so that any name can be read back
        named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
        inner = F.when(role.isin(list(OPEN)), text).otherwise(named)
        return F.concat(_mark(role, OPEN, OTHER_OPEN), F.lit(" "), escape(inner) if escaped else inner, F.lit(" "),
                        _mark(role, CLOSE, OTHER_CLOSE))

    return F.array_join(F.transform(turns, one), "")


def _odd(array: str, wanted: int) -> Column:
    return F.filter(array, lambda _, i: i % 2 == wanted)


def parse(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add `out`: the turns (role, text, start, end) read from the rendered column `text`.

    start and end bound the turn's text, as it stands in the rendered text, in code points, end exclusive. `out` is null
    where the text does not follow the grammar.
    """
    controls, parts, starts = f"{out}_controls", f"{out}_parts", f"{out}_starts"
    df = df.withColumns({controls: F.regexp_extract_all(text, F.lit(CONTROL), F.lit(0)),
                         parts: F.split(text, CONTROL, -1)})
    # where the text after each control string begins
    sizes = F.zip_with(controls, F.slice(parts, F.lit(1), F.size(controls)), lambda c, p: F.length(p) + F.length(c))
    df = df.withColumn(starts, scan(sizes))
    turns = F.arrays_zip(_odd(controls, 0).alias("open"), _odd(controls, 1).alias("close"), _odd(parts, 1).alias("inner"),
                         _odd(starts, 0).alias("start"))

    def turn(t):
        inner = unescape(F.substring(t["inner"], F.lit(2), F.length(t["inner"]) - 2))
        other = t["open"] == OTHER_OPEN
        digits = F.substring_index(inner, ":", 1)
        size = digits.try_cast("int")
        role = F.lit(None).cast("string")
        for name, mark in OPEN.items():
            role = F.when((t["open"] == mark) & (t["close"] == CLOSE[name]), F.lit(name)).otherwise(role)
        named = F.substring(inner, F.length(digits) + 2, size)
        rest = F.substring(inner, F.length(digits) + 2 + size, F.length(inner))
        return F.struct(
            F.when(other & (t["close"] == OTHER_CLOSE), named).otherwise(role).alias("role"),
            F.when(other, rest).otherwise(inner).alias("text"),
            (t["start"] + 1).alias("start"), (t["start"] + F.length(t["inner"]) - 1).alias("end"))

    found = F.transform(turns, turn)
    well = ((F.size(controls) % 2 == 0) & F.forall(_odd(parts, 0), lambda p: p == "")
            & F.forall(_odd(parts, 1), lambda p: p.startswith(" ") & p.endswith(" ") & (F.length(p) >= 2)))
    return df.withColumn(out, F.when(well, found)).drop(controls, parts, starts)


def _told(column: str) -> Column:
    return F.transform(column, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def formatted(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, escaped, round_trip, turns, loss.

    `conversations` has conv_id, turn, role, text; other columns do not matter. Turns go by (turn, role, text), nulls first, so
    ties and repeated rows have one order and all are written. A null text or role is empty; a role other than the
    three known ones is written with its name. A null conv_id is a conversation of its own. An empty table gives an
    empty result. `n_turns` counts the turns read back. `turns` are the turns read back from `formatted` (role, text, start, end); `loss` are the spans of the assistant's
    texts in `formatted`. `round_trip` says that the turns read back are the source's, which the escape ensures.
    """
    told = F.struct(F.col("turn").cast("long").alias("turn"),
                    F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = (conversations.select(F.col("conv_id").cast("long").alias("conv_id"), told.alias("t"))
          .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("source"))
          .select("conv_id", _told("source").alias("source")))
    df = parse(df.withColumn("plain", render(F.col("source"), False)), "plain", "read")
    df = df.withColumn("escaped", ~F.coalesce(_told("read") == F.col("source"), F.lit(False))).drop("read")
    df = df.withColumn("formatted", F.when(F.col("escaped"), render(F.col("source"), True)).otherwise(F.col("plain")))
    df = parse(df.drop("plain"), "formatted", "turns")
    return df.select(
        "conv_id", F.coalesce(F.size("turns"), F.lit(0)).cast("long").alias("n_turns"), "formatted", "escaped",
        F.coalesce(_told("turns") == F.col("source"), F.lit(False)).alias("round_trip"), "turns",
        F.transform(F.filter("turns", lambda t: t["role"] == "assistant"),
                    lambda t: F.struct(t["start"], t["end"])).alias("loss"))


def digests(chats: DataFrame) -> DataFrame:
    """Turns and loss text of `formatted`, read from its output only."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(cut(F.col("formatted"), F.col("loss")), unescape), "")
    return (chats.withColumn("loss_text", loss)
            .select("conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"),
                    F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars")))
