"""Mixing sources to target weights, in DataFrame functions.

Every document gets a pseudo-random key from its id. Word counts are summed by source and range of keys; prefix sums
over the ranges lead to the one range of each source in which its budget ends, and prefix sums over that range's rows
to the very document. A source is thus cut at its exact budget: whole epochs first, then the documents in key order up to the
last word of the budget. Documents are not sorted or shuffled: each compares its key with its source's cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablestore.llm.common import SPACES, checkpoint, fresh, quoted, words

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Leading hex digits of the key that name a range, and rows up to which the rows of a range are ranked in one task; ranges
#: of more are divided again by as many digits.
RANGE_DIGITS = 3
RANGE_ROWS = 200_000
#: Plans of at most this number of sources are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def budgets(sources: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add target (double) to one row for each source: `source` and source_size.

    Sources go by code point, null last, and take the weights in turn. They share the total by weight, none above
    max_epochs times its size: what exceeds a source's limit is shared again by weight among the others until none is above.
    Taken in order of limit for each weight, the sources above the water level come first, so one pass of prefix sums
    finds the level. A source of size 0 gets 0. One task sorts the sources, not their documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sources.withColumn("w", F.element_at(F.array(*(F.lit(w) for w in weights)), turn + 1)).withColumn("limit", max_epochs * F.col("source_size"))
    rows = rows.withColumn("ratio", F.col("limit") / F.col("w"))
    so_far = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"below": F.sum("limit").over(so_far) - F.col("limit"), "above": F.sum("w").over(every) - F.sum("w").over(so_far) + F.col("w"), "all": F.sum("source_size").over(every)})
    rows = rows.withColumn("per", (F.col("all") - F.col("below")) / F.col("above"))
    rows = rows.withColumn("level", F.min(F.when(F.col("per") <= F.col("ratio"), F.struct("ratio", "per"))).over(every)["per"])
    share = F.col("level") * F.col("w")
    return rows.select(*sources.columns, F.when(share > F.col("limit"), F.col("limit").cast("double")).otherwise(share).alias("target"))


def key_of(id: Column, text: Column) -> Column:
    """A pseudo-random key as hex; the text decides where ids are null."""
    return F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(id.cast("string"), F.lit("")), F.when(id.isNull(), F.md5(F.coalesce(text, F.lit(""))))))


def _count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


class _Names:
    """The helper columns of a mix, which clash with none of the caller's."""

    def __init__(self):
        self.src, self.key, self.size = fresh("source"), fresh("key"), fresh("size")

    def keyed(self, docs: DataFrame, id: str, text: str, source: str, carry: list[Column]) -> DataFrame:
        """The source as a name that is never null (0 for null, else 1 and the source), the key, and the carried columns."""
        return docs.select(F.coalesce(F.concat(F.lit("1"), quoted(source)), F.lit("0")).alias(self.src), key_of(quoted(id), quoted(text)).alias(self.key), *carry)


def _cuts(docs: DataFrame, id: str, text: str, source: str, weights: tuple, max_epochs: int, names: _Names) -> DataFrame:
    """One row for each source: its name, source_size, target, epochs, and where its budget ends: cut_key, cut_size and
    cut (words) of a document, how many rows of equal key and size come before it (ahead) and how many there are (ties)."""
    src, key, size = names.src, names.key, names.size
    sized = names.keyed(docs, id, text, source, [_count(quoted(text)).alias(size)])
    cells = sized.groupBy(src, F.substring(key, 1, RANGE_DIGITS).alias("range")).agg(F.sum(size).alias("words"), F.count(F.lit(1)).alias("n"))
    cells = checkpoint(cells)
    n = cells.count()
    real = F.when(F.col(src) != "0", F.expr(f"substring({src}, 2)"))
    plan = budgets(cells.groupBy(src).agg(F.sum("words").alias("source_size")).withColumn("source", real), weights, max_epochs).drop("source")
    whole = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs).cast("long"), F.expr("floor(target) div source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.when(F.col("epochs") < max_epochs, whole - F.col("epochs") * F.col("source_size")).otherwise(0))
    plan = checkpoint(plan, n)
    # the range in which the rest ends, and the words before it
    open_ = plan.where("rest > 0").select(src, F.col("rest"), F.lit("").alias("range"))
    digits = RANGE_DIGITS
    while True:
        in_order = Window.partitionBy(src).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        placed = cells.withColumn("before", F.coalesce(F.sum("words").over(in_order), F.lit(0))).join(open_.select(src, "rest"), src)
        open_ = checkpoint(placed.where("before < rest and rest <= before + words").select(src, (F.col("rest") - F.col("before")).alias("rest"), "range", "n"), n)
        if digits >= 32 or (open_.agg(F.max("n")).first()[0] or 0) <= RANGE_ROWS:
            break
        inside = names.keyed(docs, id, text, source, [quoted(text).alias("text")]).withColumn("range", F.substring(key, 1, digits))
        inside = inside.join(F.broadcast(open_.select(src, "range")), [src, "range"])
        digits = min(32, digits + RANGE_DIGITS)
        cells = checkpoint(inside.groupBy(src, F.substring(key, 1, digits).alias("range")).agg(F.sum(_count(F.col("text"))).alias("words"), F.count(F.lit(1)).alias("n")))
    inside = names.keyed(docs, id, text, source, [quoted(text).alias("text")]).withColumn("range", F.substring(key, 1, digits))
    inside = inside.join(F.broadcast(open_.drop("n")), [src, "range"]).select(src, key, "rest", _count(F.col("text")).alias(size))
    # rows of equal key and size are one group of several
    groups = inside.groupBy(src, key, size, "rest").agg(F.count(F.lit(1)).alias("ties"))
    before = F.coalesce(F.sum(F.col(size) * F.col("ties")).over(Window.partitionBy(src).orderBy(key, size).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.withColumn("left", F.col("rest") - before).where((F.col("left") > 0) & (F.col("left") <= F.col(size) * F.col("ties")))
    ahead = F.expr(f"(left - 1) div {size}")
    ends = groups.select(src, F.col(key).alias("cut_key"), F.col(size).alias("cut_size"), (F.col("left") - ahead * F.col(size)).alias("cut"), ahead.alias("ahead"), "ties")
    return checkpoint(plan.drop("rest").join(ends, src, "left"), n)


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, extra: list[Column] = ()) -> DataFrame:
    """One row for each document: id, size, source_size, target, epochs, cut, taken, and `extra`.

    size counts words (null text: 0); epochs is how often the whole document is taken and cut how many of
    its first words are taken once more, so taken = epochs * size + cut. The sum of taken in a source is its
    target without the fraction. Rows of equal key (repeated or null ids) are ordered by size; which of two rows of
    equal key and size is cut does not matter. Null is a source of its own. An empty table gives no rows.
    """
    names = _Names()
    src, key, size = names.src, names.key, names.size
    plan = _cuts(docs, id, text, source, weights, max_epochs, names)
    several = (plan.agg(F.max("ties")).first()[0] or 0) > 1
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    carried = [fresh("x") for _ in extra]
    rows = names.keyed(docs, id, text, source, [quoted(id).alias("id"), _count(quoted(text)).alias(size), *(c.alias(n) for c, n in zip(extra, carried))]).join(plan, src)
    at_end = (F.col(key) == F.col("cut_key")) & (F.col(size) == F.col("cut_size"))
    rows = rows.withColumn("number", F.lit(0))
    if several:
        # only rows that equal a last document in key and size are numbered
        tied = F.coalesce(at_end & (F.col("ties") > 1), F.lit(False))
        numbered = rows.where(tied).withColumn("number", F.row_number().over(Window.partitionBy(src).orderBy(key)) - 1)
        rows = rows.where(~tied).unionByName(numbered)
    first = (F.col(key) < F.col("cut_key")) | (F.col(key) == F.col("cut_key")) & (F.col(size) < F.col("cut_size"))
    last = F.when(F.col("number") < F.col("ahead"), F.col(size)).when(F.col("number") == F.col("ahead"), F.col("cut")).otherwise(0)
    cut = F.coalesce(F.when(first, F.col(size)).when(at_end, last), F.lit(0)).cast("long")
    rows = rows.withColumn("cut", cut)
    return rows.select(F.col("id").alias(id), F.col(size).alias("size"), "source_size", "target", "epochs", "cut",
                       (F.col("epochs") * F.col(size) + F.col("cut")).alias("taken"),
                       *(F.col(n).alias(f"extra_{i}") for i, n in enumerate(carried)))


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
          weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself with exactly the columns of `docs`: a document once for each epoch that takes it.

    The one document of a source at which the budget ends appears once more with its first `cut` words. Null texts have
    no words and go with their source's whole epochs; repeated rows are documents of their own; an empty table gives no rows.
    Whole rows are not shuffled.
    """
    rows = mix(docs, id, text, source, weights, max_epochs, extra=[F.struct(*(quoted(c) for c in docs.columns))])
    row = F.col("extra_0")
    starts = F.split(row[text], "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])")
    # white space before the first word is a piece of its own
    skip = F.when(F.translate(F.get(starts, F.lit(0)), SPACES, "") == "", 1).otherwise(0)
    begun = row.withField("`" + text.replace("`", "``") + "`", F.array_join(F.slice(starts, 1, F.col("cut").cast("int") + skip), ""))
    again = F.when(F.col("cut") < 1, F.slice(F.array(row), 1, 0)).when(F.col("cut") < F.col("size"), F.array(begun)).otherwise(F.array(row))
    copies = F.concat(F.array_repeat(row, F.col("epochs").cast("int")), again)
    return rows.select(F.explode(copies).alias("row")).select("row.*")
