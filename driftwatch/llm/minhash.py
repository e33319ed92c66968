"""Near-duplicate groups: inverted join of MinHash signature coordinates, confirmed on the full shingle sets.

Every distinct shingle set gets `COORDINATES` MinHash values. A set is posted under its (coordinate, value) pairs, but
only under the rarest ones: two sets that agree in at least t coordinates must meet in one of the first
COORDINATES - t + 1 of any common order (prefix), and the long lists at the end of that order are skipped and counted on
the signatures instead. t is so low that a pair at the wanted similarity is missed with a probability below `MISS`.
Short lists give all their pairs; a long list compares its members with one hub, and what stays in several
components after that is narrowed by an exact bound before the next hubs, and from then on a pair is only formed if the
parities of its sets allow the similarity. So a large group of near copies costs one pair for each
member, not all pairs. All pairs that agree in t coordinates are confirmed on the full sets.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm import words
from driftwatch.llm.components import components
from driftwatch.storage import stage

COORDINATES = 32
MISS = 1e-8
SHORT, GROWTH = 24, 16  # members of a list that gives all its pairs at once, and its growth in each further round
RARE = 8  # members that share a shingle, at most, for all their pairs to be compared when long lists are narrowed
COUNTERS = 1 << 18  # of the rarity order, whatever the number of documents
ID_CLASSES = 1 << 21  # of the filters on ids, likewise
PARITY = 512  # hash classes of a set whose numbers of shingles are known to be odd or even
SALTS = 64  # parts that the members of a list are dealt to when they meet what is known of their list
_MULTIPLIERS = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def match_threshold(similarity: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest t for which fewer than t agreements at this similarity have a probability of at most `miss`."""
    below, t = 0.0, 0
    while t < coordinates:
        below += math.comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if below > miss:
            break
        t += 1
    return max(1, t)


def _signature(one, multipliers):
    best = np.full(len(multipliers), 2**32 - 1, np.uint64)
    for a in range(0, len(one), 1 << 14):
        best = np.minimum(best, ((one[a : a + (1 << 14), None] * multipliers) >> np.uint64(32)).min(axis=0))
    return best.astype(np.uint32).view(np.int32)


def _parity(one):
    """Whether each of PARITY hash classes holds an odd number of shingles, as 64-bit numbers.

    Two sets differ in at least as many shingles as these bits differ, which rules out pairs exactly and without the sets.
    """
    odd = np.bincount((one >> np.uint64(40)) & np.uint64(PARITY - 1), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _texts(column):
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def signatures(docs: DataFrame, size: int, coordinates: int = COORDINATES) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, sig, parity) of every row; f1 and f2 identify the shingle set."""
    multipliers = _MULTIPLIERS[:coordinates]

    def run(batches):
        for batch in batches:
            for sub in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
                n, f1, f2, sig, parity = [], [], [], [], []
                for one in words.shingle_sets(_texts(sub.column(1)), size):
                    n.append(len(one))
                    f1.append(one.sum(dtype=np.uint64).astype(np.int64) if len(one) else 0)
                    f2.append(np.bitwise_xor.reduce(words.mix(one)).astype(np.int64) if len(one) else 0)
                    sig.append(_signature(one, multipliers))
                    parity.append(_parity(one))
                flat, odd = np.concatenate(sig), np.concatenate(parity)
                offsets = pa.array(np.arange(0, len(flat) + 1, coordinates), pa.int32())
                places = pa.array(np.arange(0, len(odd) + 1, PARITY // 64), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [sub.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())),
                     pa.ListArray.from_arrays(places, pa.array(odd, pa.int64()))],
                    ["doc_id", "n_shingles", "f1", "f2", "sig", "parity"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_shingles long, f1 long, f2 long, sig array<int>, parity array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc_id, set) of the documents in `ids` (doc_id), from their texts.

    A filter of at most ID_CLASSES id classes, which is broadcast, spares most other texts; the classes that it lets
    through besides are harmless, as callers join on doc_id.
    """
    def run(batches):
        for batch in batches:
            for sub in (batch.slice(a, 200) for a in range(0, batch.num_rows, 200)):
                sets = list(words.shingle_sets(_texts(sub.column(1)), size))
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [sub.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                                             pa.array(flat.view(np.int64), pa.int64()))],
                    ["doc_id", "set"])

    kind = F.pmod(F.xxhash64("doc_id"), F.lit(ID_CLASSES)).alias("kind")
    wanted = F.broadcast(ids.select(kind).distinct())
    some = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("kind", kind)
    return some.join(wanted, "kind", "left_semi").select("doc_id", "text").mapInArrow(
        run, "doc_id long, set array<long>")


def rarity(sets: DataFrame) -> np.ndarray:
    """How often the coordinate values of each hash class occur: COUNTERS numbers, whatever the input."""
    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            total += np.bincount(_kinds(_tokens(batch.column(0))).ravel(), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["kind", "n"])

    found = (sets.select("sig").mapInArrow(run, "kind long, n long")
             .groupBy("kind").agg(F.sum("n").alias("n")).toArrow())  # not pickled row by row in the driver
    out = np.zeros(COUNTERS, np.int64)
    out[found["kind"].to_numpy()] = found["n"].to_numpy()
    return out


def _tokens(column):
    values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint32).astype(np.uint64)
    values = values.reshape(len(column), -1)
    return (np.arange(values.shape[1], dtype=np.uint64) << np.uint64(32)) | values


def _kinds(tokens):
    return (words.mix(tokens) & np.uint64(COUNTERS - 1)).astype(np.int64)


def postings(sets: DataFrame, prefix: int) -> DataFrame:
    """(token, doc_id, n, code) under the `prefix` rarest coordinate values of every set.

    n is the size of the set; code holds the last two bits of the first 32 coordinates, which tells most pairs apart at once.
    """
    counts = sets.sparkSession.sparkContext.broadcast(rarity(sets))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = _tokens(batch.column(2))
            order = np.lexsort((words.mix(tokens), counts.value[_kinds(tokens)]))[:, :prefix]
            picked = np.take_along_axis(tokens, order, axis=1)
            bits = (tokens[:, :32] & np.uint64(3)) << (2 * np.arange(min(32, tokens.shape[1]), dtype=np.uint64))
            code = np.bitwise_or.reduce(bits, axis=1).view(np.int64)
            each = [np.repeat(c, picked.shape[1]) for c in (
                batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), code)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(picked.ravel().view(np.int64)), *(pa.array(c, pa.int64()) for c in each)],
                ["token", "doc_id", "n", "code"])

    return sets.select("doc_id", F.col("n_shingles").alias("n"), "sig").mapInArrow(
        run, "token long, doc_id long, n long, code long")


def _alike(least: int, coordinates: int, num: int, den: int) -> str:
    """Condition on a pair (na, ca, pa), (nb, cb, pb) of sizes, codes and parities that all linked pairs meet which agree in `least`
    coordinates; a parity may be null."""
    seen = min(32, coordinates)
    differ = "bit_count(((ca ^ cb) | shiftright(ca ^ cb, 1)) & 6148914691236517205L)"
    return (f"{seen} - {differ} >= {least - (coordinates - seen)} and least(na, nb) * {den} >= greatest(na, nb) * {num} and "
            + _few_differ(num, den))


def _few_differ(num: int, den: int) -> str:
    """At most (na + nb) * (den - num) / (den + num) shingles of a linked pair are in one of its sets only."""
    odd = " + ".join(f"bit_count(pa[{k}] ^ pb[{k}])" for k in range(PARITY // 64))
    return f"coalesce({odd}, 0) * {num + den}L <= (na + nb) * {den - num}L"


def _sides(df: DataFrame, key: str, *more: str) -> tuple[DataFrame, DataFrame]:
    if "parity" not in df.columns:
        df = df.withColumn("parity", F.lit(None).cast("array<long>"))
    return tuple(df.select(key, F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("code").alias(f"c{x}"),
                           F.col("group").alias(f"g{x}"), F.col("parity").alias(f"p{x}"), *more) for x in "ab")


def _all_pairs(df: DataFrame, key: str, alike: str, once: bool = False) -> DataFrame:
    """Pairs of different groups under one key, which has few rows; with `once`, only under the least key that they share."""
    if once:
        keys = df.groupBy("doc_id").agg(F.collect_list(key).alias("keys"))  # as many as a prefix is long
        left, right = _sides(df.join(keys, "doc_id"), key, "keys")
        left, right = left.withColumnRenamed("keys", "ka"), right.withColumnRenamed("keys", "kb")
        return left.join(right, key).where(
            f"a < b and ga <> gb and {alike} and array_min(array_intersect(ka, kb)) = {key}").select("a", "b")
    left, right = _sides(df, key)
    return left.join(right, key).where(f"a < b and ga <> gb and {alike}").select("a", "b")


def _agreeing(pairs: DataFrame, sets: DataFrame, least: int, num: int, den: int) -> DataFrame:
    """Pairs that agree in at least `least` coordinates and whose sizes allow the similarity."""
    a = sets.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"), F.col("parity").alias("pa"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"), F.col("parity").alias("pb"))
    same = F.expr("size(filter(zip_with(sa, sb, (x, y) -> x = y), e -> e))")
    return (pairs.join(b, "b").join(a, "a").where(f"least(na, nb) * {den} >= greatest(na, nb) * {num}")
            .where(_few_differ(num, den)).where(same >= least).select("a", "b", "na", "nb"))


def _linked(docs: DataFrame, pairs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs whose full sets have den * |intersection| >= num * |union|."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
    full = stage(full_sets(docs, ids, size), "full-sets")
    a, b = full.toDF("a", "xa"), full.toDF("b", "xb")
    common = F.size(F.array_intersect("xa", "xb"))
    return (pairs.join(b, "b").join(a, "a").withColumn("common", common)
            .where(f"{den} * common >= {num} * (na + nb - common)").select("a", "b"))


def _with_facts(lists: DataFrame, facts: dict) -> DataFrame:
    """The postings of `lists` with aggregates of their list; a long list is dealt by (token, salt), not by its token alone."""
    salted = lists.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    known = salted.groupBy("token").agg(*(c.alias(k) for k, c in facts.items()), F.collect_set("salt").alias("salts"))
    return salted.join(known.where("members > 1").withColumn("salt", F.explode("salts")).drop("salts"), ["token", "salt"]).drop("salt")


def _grouped(lists: DataFrame, found: DataFrame) -> DataFrame:
    """The postings of `lists` with their document's component as `group`, written, as it is the same for all passes of a round.

    A document meets its component once, not once for each of its lists, of which a prefix bounds the number.
    """
    each = lists.groupBy("doc_id").agg(*(F.first(c).alias(c) for c in ("n", "code", "parity")), F.collect_list("token").alias("tokens"))
    return stage(each.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        F.explode("tokens").alias("token"), "doc_id", "n", "code", "parity", F.coalesce("component", "doc_id").alias("group")), "grouped-lists")


def _mixed(member: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The lists whose members are in several groups, with what is needed of each list's hub (its smallest doc_id).

    With `found`, the groups of the members are the components there.
    """
    if found is not None:
        member = _grouped(member.select("token", "doc_id", "n", "code", "parity"), found)
    hub = {f"hub_{c}": F.min_by(c, "doc_id") for c in ("group", "n", "code", "parity")}
    facts = {"members": F.count("*"), "hub": F.min("doc_id"), **hub, "mixed": F.min("group") != F.max("group")}
    return stage(_with_facts(member, facts).where("mixed").drop("mixed"), "mixed-lists")


def _narrowed(docs: DataFrame, sets: DataFrame, lists: DataFrame, size: int, num: int, den: int, alike: str, rare: int) -> tuple:
    """Drop members of long lists that cannot have a link to another member, but for pairs that are returned besides.

    A pair of different groups either has a shingle in common that at most `rare` members have, and then is returned as one of that
    shingle's pairs, or shares at most n - own of either set, where `own` counts such shingles and those that one group has alone;
    that must reach num / den of the union with the smallest partner that the list and the similarity allow. Each member is judged by itself first; only what is
    left of the lists, with the parities of its members, is judged list by list. Every step is written, so that the next one does not repeat it.
    """
    members = stage(lists.select("doc_id", "n", "code", "group").distinct(), "members")
    shingle = full_sets(docs, members, size).join(members, "doc_id").select(
        "doc_id", "n", "code", "group", F.explode("set").alias("s"))
    if rare > 1:
        shingle = stage(shingle, "member-shingles")
    seen = shingle.groupBy("s").agg(F.count("*").alias("times"), F.min("doc_id").alias("doc_id"),
                                    (F.min("group") == F.max("group")).alias("alone"))
    pairs = None
    if rare > 1:
        few = stage(shingle.join(seen.where(f"alone or times <= {rare}").select("s", "times", "alone"), "s"), "few-have")
        pairs = stage(_all_pairs(few.where("not alone").drop("alone"), "s", alike).distinct(), "rare-pairs")
        seen = few
    else:
        seen = seen.where("times = 1")
    facts = stage(members.join(seen.groupBy("doc_id").agg(F.count("*").alias("own")), "doc_id", "left")
                  .withColumn("own", F.coalesce("own", F.lit(0))).where(f"(n - own) * {den} >= n * {num}")
                  .join(sets.select("doc_id", "parity"), "doc_id").select("doc_id", "own", "parity"), "facts")
    left = stage(lists.select("token", "doc_id", "n", "code", "group").join(facts, "doc_id"), "possible")
    # the smallest partner has max(least, n * num / den) shingles; more passes could lift the smallest size, any number is exact
    listed = _with_facts(left, {"members": F.count("*"), "least": F.min("n"), "mixed": F.min("group") != F.max("group")})
    left = stage(listed.where("mixed").where(
        f"(n - own) * {(num + den) * den}L >= {num}L * (n * {den} + greatest(least * {den}, n * {num}))").select(left.columns), "possible")
    return left.select("token", "doc_id", "n", "code", "parity", "group"), pairs


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100,
                    coordinates: int = COORDINATES, short: int = SHORT) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked when den * |intersection| >= num * |union| of their distinct `size`-word shingles;
    component_id is the smallest doc_id reachable over links, and kept marks the document of that id. A text with fewer words
    is one shingle; null, empty and blank texts have none and are linked with nothing. Equal sets are one
    node, so copies cost one row each. Rows that repeat a doc_id are one document: each gets a row, and texts that share a doc_id
    share its component. A null doc_id takes part through an equal set only and is kept when it has none. Other columns of
    `docs` do not matter. An empty table gives an empty result.
    """
    least = match_threshold(num / den, coordinates)
    alike = _alike(least, coordinates, num, den)
    rows = stage(signatures(docs, size, coordinates), "signatures")
    sets = stage(rows.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2", "n_shingles")
                 .agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("parity").alias("parity")), "sets")
    # a value that one set has takes a place in the prefix and needs no list: its only member is of one component
    lists = stage(postings(sets, coordinates - least + 1), "postings")
    # parities would only swell these lists, which give few pairs for each member
    member = _mixed(lists.withColumns({"parity": F.lit(None).cast("array<long>"), "group": F.col("doc_id")}))
    links = pairs = None
    while True:
        few = _all_pairs(member.where(F.col("members") <= short), "token", alike, once=links is not None)
        hubs = member.where((F.col("members") > short) & (F.col("group") != F.col("hub_group"))).select(
            F.col("hub").alias("a"), F.col("doc_id").alias("b"), F.col("hub_n").alias("na"), F.col("n").alias("nb"),
            F.col("hub_code").alias("ca"), F.col("code").alias("cb"), F.col("hub_parity").alias("pa"),
            F.col("parity").alias("pb")).where(alike).select("a", "b")
        found_pairs = few.union(hubs) if pairs is None else few.union(hubs).union(pairs)
        agreeing = stage(_agreeing(found_pairs.distinct(), sets, least, num, den), "pairs")
        linked = stage(_linked(docs, agreeing, size, num, den), "links")
        links = linked if links is None else links.union(linked)
        found = components(links)
        long = member.where((F.col("members") > short) & (F.col("doc_id") != F.col("hub")))
        member = _mixed(long, found)
        pairs = None
        for rare in (1, RARE) if links is linked else (RARE,):  # the first round has the most members, and a cheap pass before
            if not member.isEmpty():
                left, pairs = _narrowed(docs, sets, member, size, num, den, alike, rare)
                member = _mixed(left)
        if member.isEmpty() and (pairs is None or pairs.isEmpty()):
            break
        short *= GROWTH
    groups = sets.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "f1", "f2", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "f1", "f2").join(groups, ["f1", "f2", "n_shingles"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.col("component_id").isNull()).alias("kept"))
