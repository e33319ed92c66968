"""Mixing sources to target weights through a tree of domains, languages and sources.

A budget of tokens goes down the tree by weight. A child gets no more than it can give (its tokens times the largest
number of epochs); what it cannot give goes to its siblings by weight, and only what a whole subtree cannot give goes to
the subtree's siblings. Each leaf then takes whole epochs and a prefix of one more, in a seeded order of its documents.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.storage import stage

DIGITS = (2, 5)  # of the order key in hex: 256 buckets of a leaf, then 4,096 of the one in which its budget ends
LEVELS = ("domain", "language", "origin")


def tokens(text: Column) -> Column:
    """The number of words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weights(column: Column, given: dict[str, int], other: int) -> Column:
    """A whole-number weight by name; names that are not given have the weight `other`."""
    out = F.lit(other)
    for name, weight in given.items():
        out = F.when(column == name, F.lit(weight)).otherwise(out)
    return out.cast("long")


def share_out(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Divide each parent's `given` among its children: adds `budget` to (parent, child, capacity, weight, given).

    Children fill up in the order of capacity / weight. The first that does not fill up fixes the level at which all
    later ones stop: what is left times weight over the weights left, rounded down.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), child)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.greatest(F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0)), F.lit(0)).cast("decimal(38,0)")
    df = children.withColumns({"rest": rest, "left": F.sum("weight").over(after)})
    level = df.withColumn("full", F.col("capacity").cast("decimal(38,0)") * F.col("left") <= F.col("rest") * F.col("weight"))
    # behind the first child that is not full, none is
    stopped = F.struct((~F.col("full")).alias("stop"), F.col("rest").alias("rest"), F.col("left").alias("left"))
    first = F.first(F.when(~F.col("full"), stopped), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (level.withColumn("first", first)
            .withColumn("budget", F.when(F.col("first").isNull(), F.col("capacity")).otherwise(
                F.least(F.col("capacity"), F.expr("cast((first.rest * weight) div first.left as bigint)"))))
            .drop("rest", "left", "full", "first"))


def budgets(leaves: DataFrame, total: Column, epochs: int, domain_weights: dict, language_weights: dict,
            source_weights: dict, other: int) -> DataFrame:
    """(domain, language, origin, available, budget) from leaves (domain, language, origin, available)."""
    names = ["root", *LEVELS]
    out = leaves.withColumn("root", F.lit(0)).withColumn("capacity", F.col("available") * epochs)
    top = (out.groupBy("root").agg(F.sum("capacity").alias("capacity"), F.sum("available").alias("available"))
           .select("root", F.least("capacity", total).alias("given")))
    for k, given in enumerate((domain_weights, language_weights, source_weights), 1):
        children = (out.groupBy(*names[: k + 1]).agg(F.sum("capacity").alias("capacity"))
                    .withColumn("weight", weights(F.col(names[k]), given, other)).where("capacity > 0 and weight > 0"))
        top = share_out(children.join(top, names[:k]), names[:k], names[k]).select(
            *names[: k + 1], F.col("budget").alias("given"))
    return leaves.join(top.drop("root"), list(LEVELS)).select(*LEVELS, "available", F.col("given").alias("budget"))


def mixture(docs: DataFrame, domain: Column, domain_weights: dict[str, int], language_weights: dict[str, int],
            source_weights: dict[str, int], share: tuple[int, int] = (3, 5), epochs: int = 2, seed: int = 1,
            other: int = 1) -> DataFrame:
    """(doc_id, epoch, domain, language, origin, n_tokens): a row for each time a document of `docs` is taken.

    `docs` has doc_id, text, lang, source; `domain` is an expression over them. The total budget is share[0] / share[1]
    of all tokens; a leaf gives at most `epochs` times its tokens. Weights are whole numbers; names that are not given weigh
    `other`; a weight of 0 takes nothing. Budgets are rounded down, less than one token per node. In each epoch a leaf's documents have a new order by md5 of seed, epoch
    and doc_id (ties: n_tokens); whole documents are taken while their running sum is within what the budget leaves. Null
    names are the name "". Null, empty and blank texts have no tokens; they are taken with any leaf that has a budget and
    whose prefix reaches them. Rows that repeat a doc_id are taken each by itself. Other columns do not matter; an empty table gives an
    empty result.

    A leaf may hold most documents: its tokens are first summed by buckets of the order, whole buckets are taken or
    left, the one bucket in which the budget ends is divided again, and only the documents of the last one are sorted.
    """
    names = list(LEVELS)
    clean = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = stage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), clean(domain).alias("domain"), clean(F.col("lang")).alias("language"),
        clean(F.col("source")).alias("origin"), tokens(F.col("text").cast("string")).alias("n_tokens")), "mix-rows")
    leaves = stage(rows.groupBy(*names).agg(F.sum("n_tokens").alias("available")), "mix-leaves")
    total = F.expr(f"cast(available * {int(share[0])}L div {int(share[1])}L as bigint)")
    plan = stage(budgets(leaves, total, epochs, domain_weights, language_weights, source_weights, other)
                 .where("budget > 0")
                 .withColumn("full", F.expr("cast(budget div available as bigint)"))
                 .withColumn("rest", F.col("budget") - F.col("full") * F.col("available")), "mix-plan")
    taken = rows.join(plan.select(*names, "full", "rest"), names)
    whole = taken.where("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), "full")))
    key = F.md5(F.concat_ws(":", F.lit(seed), (F.col("full") + 1).cast("string"),
                            F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    last = (taken.where("rest > 0").withColumn("key", key).withColumn("before", F.lit(0).cast("long")))
    columns = ["doc_id", "epoch", *names, "n_tokens"]
    out = whole.select(*columns)
    for digits in DIGITS:
        last = last.withColumn("bucket", F.substring("key", 1, digits))
        sums = last.groupBy(*names, "bucket", "rest", "before").agg(F.sum("n_tokens").alias("tokens"))
        upto = F.col("before") + F.sum("tokens").over(Window.partitionBy(*names).orderBy("bucket"))
        cut = stage(sums.withColumn("upto", upto), "mix-buckets")
        inside = cut.where("upto <= rest").select(*names, "bucket")
        border = cut.where("upto > rest and upto - tokens <= rest").select(
            *names, "bucket", (F.col("upto") - F.col("tokens")).alias("start"))
        found = last.join(inside, [*names, "bucket"], "left_semi")
        out = out.unionByName(found.withColumn("epoch", F.col("full") + 1).select(*columns))
        last = last.join(border, [*names, "bucket"]).withColumn("before", F.col("start")).drop("start", "bucket")
    running = F.sum("n_tokens").over(Window.partitionBy(*names).orderBy("key", "n_tokens", "doc_id")
                                     .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = last.withColumn("running", F.col("before") + running).where("running <= rest")
    return out.unionByName(found.withColumn("epoch", F.col("full") + 1).select(*columns))
