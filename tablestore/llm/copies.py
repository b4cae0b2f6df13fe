"""One document of each group of near-duplicates, by wide SimHash fingerprints and exact shingle sets.

Texts that share 0.8 of their 5-word shingles differ in up to 15 of the 64 bits of a fingerprint: far more than blocks of
bits can find. The fingerprints here have 256 bits, over pairs of words, of which such texts differ in about 25, and texts that
have nothing to do with each other in 128, give or take 8. So a wide budget makes no chance links, however many texts
there are. Fingerprints meet in groups that agree in a few of their bits; several selections of bits, whose
number and length follow from the number of fingerprints, find the same share of the pairs at every size. Each task joins the tries
of its groups with themselves, as for narrow fingerprints. In a group of many members, each is first compared with a few pivots
of the group; what is near a pivot is linked to it, and only what the distances from pivots leave open is compared, in cells.
What is linked is then compared by its whole sets of shingles.
"""

from __future__ import annotations

from math import ceil, log, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablestore.llm import blocks
from tablestore.llm.common import FILE_ROWS, checkpoint, fresh, quoted, release_memory, shuffle_partitions, text_slices
from tablestore.llm.components import connected
from tablestore.llm.neardup import BROADCAST_GROUPS, BROADCAST_ROWS, TASK_ROWS, _signed, _trie_task, join_labels

#: Words of 64 bits of a fingerprint, the words of its shingles, and the budget of differing bits.
WORDS, SHINGLE, BUDGET = 4, 2, 40
COLUMNS = tuple(f"w{i}" for i in range(WORDS))
BASE = 0x9E3779B97F4A7C15
ODD = np.random.default_rng(11).integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A bit agrees with this chance in texts at the limit of similarity, and this share of such pairs may share no group.
AGREE, MISSED = 0.905, 0.01
#: Bits of a group's key: at least so many, and so many less than the digits of the number of fingerprints.
KEY_BITS, LESS = 16, 3
#: The members of a group of more are compared with this number of pivots, as often as there are levels.
HOT_GROUP, PIVOTS, LEVELS = 1000, 16, 3
#: Texts of a component that are compared with each other in a round, and others that are compared with them in one task.
ROUND_TEXTS, CHUNK_TEXTS = 256, 512


def wide_many(texts: pa.Array) -> np.ndarray:
    """A row of WORDS numbers for each text: by bit, the majority of its lower-cased shingles. No words: zeros."""
    w = blocks.Words(texts, lower=True)
    sizes, out = w.lengths(), np.zeros((len(w), WORDS), np.uint64)
    if not len(w.ids):
        return out
    values = blocks.mix(w.hashes())[w.ids]
    grams = np.append(blocks.rolling(values, SHINGLE, BASE), np.zeros(SHINGLE - 1, np.uint64))[:len(values)]
    # a shorter text is one shingle, its first word
    last = np.repeat(w.starts[1:] - SHINGLE, sizes)
    place = np.arange(len(values))
    grams = np.where(np.repeat(sizes < SHINGLE, sizes), blocks.mix(values), grams)
    grams = grams[(place <= last) | np.repeat(sizes < SHINGLE, sizes) & (place == np.repeat(w.starts[:-1], sizes))]
    real = np.flatnonzero(sizes)
    counts = np.maximum(sizes[real] - SHINGLE + 1, 1)
    starts = np.append(0, np.cumsum(counts))
    # bits are counted four at a time in lanes of 16 bits; pieces are short enough for them
    pieces = np.unique(np.concatenate([starts[:-1], np.arange(0, starts[-1], 1 << 15)]))
    first = np.searchsorted(pieces, starts[:-1])
    lanes = np.uint64(0x0001000100010001)
    for k, odd in enumerate(ODD):
        h = blocks.mix(grams * odd)
        for j in range(16):
            sums = np.add.reduceat((h >> np.uint64(j)) & lanes, pieces)
            for lane in range(4):
                ones = np.add.reduceat(((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64), first)
                out[real, k] |= (2 * ones > counts).astype(np.uint64) << np.uint64(16 * lane + j)
    return out


def wide(docs: DataFrame, text: str, carry: list[Column]) -> DataFrame:
    """The carried columns as c0, c1, ... and the fingerprint's words, a row for each row of docs."""
    names = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(*(c.alias(n) for c, n in zip(carry, names)), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            for b in text_slices(batch):
                fp = wide_many(b.column("text")).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *(pa.array(fp[:, i]) for i in range(WORDS))], names=[*names, *COLUMNS])
        release_memory()

    return rows.mapInArrow(run, ", ".join([*(f"{n} {t}" for n, t in rows.drop("text").dtypes), *(f"{c} long" for c in COLUMNS)]))


def selections(bits: int, number: int, seed: int) -> list[list[int]]:
    """Masks, by word, of `number` selections of `bits` bits; a bit comes again only when all have been taken."""
    draw, out, left = np.random.default_rng(seed), [], []
    while len(out) < number:
        if len(left) < bits:
            left = [*left, *(p for p in draw.permutation(64 * WORDS).tolist() if p not in left)]
        mask = [0] * WORDS
        for p in left[:bits]:
            mask[p // 64] |= 1 << p % 64
        out.append(mask)
        left = left[bits:]
    return out


def _keys(masks: list[list[int]]) -> Column:
    return F.array(*(F.xxhash64(F.lit(0), F.lit(i), *(F.col(c).bitwiseAND(F.lit(_signed(m))) for c, m in zip(COLUMNS, mask))) for i, mask in enumerate(masks)))


def _far(other: Column) -> Column:
    """Differing bits of a row and a struct of words."""
    return sum((F.bit_count(F.col(c).bitwiseXOR(other[c])) for c in COLUMNS), F.lit(0))


def _labelled(budget: int):
    """Groups' pivots with the least number of a pivot that each is connected with, by pivots within the budget."""
    kind = pa.list_(pa.struct([("node", pa.int64()), *((c, pa.int64()) for c in COLUMNS), ("label", pa.int32())]))

    def run(batches):
        for b in batches:
            out = []
            for own in b.column("pivots").to_pylist():
                fp = np.array([[p[c] for c in COLUMNS] for p in own], np.int64).view(np.uint64)
                labels = np.arange(len(own))
                join_labels(labels, *np.nonzero(_distances(fp, fp) <= budget))
                out.append([p | {"label": int(x)} for p, x in zip(own, labels)])
            yield pa.RecordBatch.from_arrays([b.column("group"), pa.array(out, kind)], names=["group", "pivots"])
    return run


def _distances(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    out = np.zeros((len(mine), len(theirs)), np.int16)
    for i in range(WORDS):
        out += np.bitwise_count(mine[:, i, None] ^ theirs[None, :, i])
    return out


def _near(budget: int):
    """Links (u, v) of the nodes of two tables that are within the budget: a spanning set."""
    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        fps = [np.stack([np.asarray(t[c]) for c in COLUMNS], 1).view(np.uint64) for t in (mine, theirs)]
        i, j = np.nonzero(_distances(*fps) <= budget)
        distinct, at = np.unique(np.concatenate([np.asarray(t["node"]) for t in (mine, theirs)]), return_inverse=True)
        labels = np.arange(len(distinct))
        join_labels(labels, at[i], at[mine.num_rows + j])
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.table({"u": distinct[moved], "v": distinct[labels[moved]]})
    return run


def links(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(u, v) for distinct fingerprints (node and its words): enough pairs to connect all within the budget that share a group.

    A crowded group has pivots, some of its members. Members within the budget of one are linked to it and need
    not meet each other. A member is within the budget of one linked to a pivot only if it is within twice the budget of
    the pivot: such outsiders meet all members linked to that pivot, or to one connected with it. Members near no pivot meet in the
    same way with new pivots, at last all with each other.
    """
    n = max(2, prints.count())
    bits = max(KEY_BITS, ceil(log2(n)) - LESS)
    number = ceil(log(MISSED) / log(1 - AGREE ** bits))
    rows = prints.withColumn("group", F.explode(_keys(selections(bits, number, 1))))
    spark, cold, out = prints.sparkSession, None, []
    meet = lambda a, b, key: _in_cells(a.select(*key, "node", *COLUMNS), b.select(*key, "node", *COLUMNS), key, HOT_GROUP, "node").applyInArrow(_near(budget), "u long, v long")
    for level in range(LEVELS + 1):
        hot = rows.groupBy("group").count().where(F.col("count") > HOT_GROUP).select("group")
        # counted by all tasks, written by few
        hot = checkpoint(hot.repartition(-(-n * number // HOT_GROUP // FILE_ROWS) or 1))
        many = hot.count()
        if not many:
            break
        few = F.broadcast(hot) if many <= BROADCAST_GROUPS else hot
        calm = rows.join(few, "group", "left_anti")
        cold = calm if cold is None else cold.unionByName(calm)
        crowd = checkpoint(rows.join(few, "group", "left_semi"))
        if level == LEVELS:
            out.append(meet(crowd, crowd, ["group"]))
            rows = None
            break
        # pivots are members by a hash of the node: a few of each group, from one aggregation
        slot = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(PIVOTS))
        pivots = crowd.groupBy("group").agg(*(F.min(F.when(slot == i, F.struct("node", *COLUMNS))).alias(f"p{i}") for i in range(PIVOTS)))
        pivots = pivots.select("group", F.array_compact(F.array(*(f"p{i}" for i in range(PIVOTS)))).alias("pivots"))
        words = ", ".join(f"{c}: bigint" for c in COLUMNS)
        pivots = checkpoint(pivots.mapInArrow(_labelled(budget), f"group long, pivots array<struct<node: bigint, {words}, label: int>>"), PIVOTS * many)
        far = F.transform("pivots", lambda p: F.struct(_far(p).alias("far"), p["node"].alias("node"), p["label"].alias("label")))
        met = crowd.join(F.broadcast(pivots) if many <= BROADCAST_GROUPS // PIVOTS else pivots, "group").withColumn("far", far).drop("pivots")
        met = met.withColumn("best", F.array_min("far")).withColumn("home", F.when(F.col("best.far") <= budget, F.col("best.label")))
        around = F.filter("far", lambda p: (p["far"] <= 2 * budget) & (F.col("home").isNull() | (p["label"] < F.col("home"))))
        met = checkpoint(met.withColumn("around", F.array_distinct(F.transform(around, lambda p: p["label"]))).withColumn("pivot", F.col("best.node")).drop("far", "best"))
        out.append(met.where("home is not null").select(F.col("node").alias("u"), F.col("pivot").alias("v")))
        two = pivots.select(F.explode("pivots").alias("p"), "pivots")
        distance = lambda q: sum((F.bit_count(F.col("p")[c].bitwiseXOR(q[c])) for c in COLUMNS), F.lit(0))
        two = two.select(F.col("p.node").alias("u"), F.explode(F.filter("pivots", lambda q: distance(q) <= budget)).alias("q"))
        out.append(two.select("u", F.col("q.node").alias("v")))
        outsiders = met.select("group", F.explode("around").alias("label"), "node", *COLUMNS)
        out.append(meet(met.where("home is not null").withColumn("label", F.col("home")), outsiders, ["group", "label"]))
        rows = met.where("home is null").select(*crowd.columns)
    if rows is not None:
        rows = rows if cold is None else cold.unionByName(rows)
    else:
        rows = cold
    parts = max(shuffle_partitions(spark), -(-n * number // TASK_ROWS))
    found = rows.repartition(parts, "group").mapInArrow(_trie_task(budget, COLUMNS, "node"), "u long, v long")
    for more in out:
        found = found.unionByName(more)
    return found


def _sets(texts: pa.Array, words: int) -> pa.Array:
    """The distinct 64-bit hashes of each text's shingles, in order; a shorter text is one shingle."""
    w = blocks.Words(texts, lower=True)
    values = blocks.mix(w.hashes())[w.ids]
    grams = blocks.rolling(values, words, BASE)
    out = []
    for a, b in zip(w.starts[:-1].tolist(), w.starts[1:].tolist()):
        own = grams[a:b - words + 1] if b - a >= words else blocks.rolling(values[a:b], b - a, BASE) if b > a else np.zeros(1, np.uint64)
        out.append(np.unique(own >> np.uint64(1)).astype(np.int64))
    ends = np.append(0, np.cumsum([len(x) for x in out]))
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))).cast(pa.list_(pa.int64()))


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.asarray(x.values) for x in column]


def _alike(mine: list[np.ndarray], theirs: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether each pair of sets reaches the similarity, as a matrix; the diagonal of a list with itself says nothing."""
    sets = mine if mine is theirs else [*mine, *theirs]
    sizes = np.array([len(x) for x in sets])
    _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # shingles of one set alone are only counted
    common = often > 1
    column = np.where(common, np.cumsum(common) - 1, -1)[at]
    order = np.argsort(column, kind="stable")
    column, rows = column[order], np.repeat(np.arange(len(sets)), sizes)[order]
    cut, n = len(mine), len(theirs)
    shared = np.zeros((cut, n))
    # some thousand shingles at a time
    for start in range(0, int(common.sum()), 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        whole = np.zeros((len(sets), 4096), np.float32)
        whole[rows[a:b], column[a:b] - start] = 1
        shared += whole[:cut] @ whole[-n:].T
    return shared >= similarity * (sizes[:cut, None] + sizes[None, -n:] - shared) - 1e-9


def _unlike(similarity: float):
    """Of a root's texts, by their number n: those that reach the similarity with none taken before."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("n")
        sets = _lists(rows["shingles"])
        alike = _alike(sets, sets, similarity)
        taken = []
        for i in range(len(sets)):
            if not alike[i, taken].any():
                taken.append(i)
        return rows.take(pa.array(taken, pa.int64())).drop_columns("n")
    return run


def _still_unlike(similarity: float):
    """Of some texts of a root, those that reach the similarity with none of its texts just taken."""
    def run(rows: pa.Table, taken: pa.Table) -> pa.Table:
        rows = rows.drop_columns("salt")
        if not rows.num_rows or not taken.num_rows:
            return rows
        return rows.filter(pa.array(~_alike(_lists(rows["shingles"]), _lists(taken["shingles"]), similarity).any(1)))
    return run


def _first_alike(similarity: float):
    """Of some texts of a root, those that reach the similarity with an earlier one of some others, and the first such."""
    order = [("id", "ascending"), ("digest", "ascending")]

    def run(rows: pa.Table, others: pa.Table) -> pa.Table:
        if not rows.num_rows or not others.num_rows:
            return pa.table({"root": rows["root"][:0], "digest": rows["digest"][:0], "of_id": others["id"][:0], "of": others["digest"][:0]})
        both = pa.concat_tables([rows.select(["id", "digest"]), others.select(["id", "digest"])])
        place = np.empty(both.num_rows, np.int64)
        # equal digests are one text, which is not before itself
        sorted_ = pc.sort_indices(both, sort_keys=order)
        digest = both["digest"].take(sorted_).combine_chunks()
        place[np.asarray(sorted_)] = np.append(0, np.cumsum(np.asarray(pc.not_equal(digest[1:], digest[:-1])).astype(np.int64)))
        mine, theirs = place[:rows.num_rows], place[rows.num_rows:]
        found = _alike(_lists(rows["shingles"]), _lists(others["shingles"]), similarity) & (theirs[None, :] < mine[:, None])
        hit = np.flatnonzero(found.any(1))
        best = pa.array(np.where(found[hit], theirs[None, :], both.num_rows).argmin(1) if len(hit) else np.zeros(0, np.int64))
        own = rows.take(pa.array(hit))
        return pa.table({"root": own["root"], "digest": own["digest"], "of_id": others["id"].take(best), "of": others["digest"].take(best)})
    return run


def _in_cells(rows: DataFrame, others: DataFrame, key: list[str], each: int, by: str):
    """Rows and others of the same key, cogrouped in cells of about `each` times `each`, so that each pair meets in one cell."""
    # a table may meet itself: other columns, of the same names
    others = others.select(*(F.col(c).alias(c) for c in others.columns))
    key_of = lambda part, salts: part.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / each).cast("int").alias(salts))
    sizes = checkpoint(key_of(rows, "salts").join(key_of(others, "others"), key), 0)
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_GROUPS else sizes
    own, other = (F.pmod(F.xxhash64(by), n).cast("int") for n in ("salts", "others"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = rows.join(sizes, key).withColumn("salt", own).withColumn("other", every("others"))
    b = others.join(sizes, key).withColumn("other", other).withColumn("salt", every("salts"))
    return a.drop("salts", "others").groupBy(*key, "salt", "other").cogroup(b.drop("salts", "others").groupBy(*key, "salt", "other"))


def representatives(left: DataFrame, similarity: float) -> DataFrame:
    """(id, digest) of the texts to keep of (root, id, digest, shingles), see keep_one.

    A round compares the next texts of each root with each other, and what is left of the root, in parts, with those
    of them that it keeps. Most roots need one round, as do many copies of one text. What is left of the others is
    compared with itself, in cells: a text with no similar one before it stays, one whose first similar text stays goes, and so
    does one that is similar to any that stays. Only the others need another round, so that the number of rounds follows the longest
    chain of similar texts, not the number of texts of a root.
    """
    kind = ", ".join(f"{n} {t}" for n, t in left.dtypes)
    types = dict(left.dtypes)
    pairs = f"root {types['root']}, digest string, of_id {types['id']}, of string"
    by_root = Window.partitionBy("root").orderBy(F.col("id").asc_nulls_last(), "digest")
    next_ = lambda rows: rows.withColumn("n", F.row_number().over(by_root)).where(F.col("n") <= ROUND_TEXTS)
    kept = None
    while True:
        n = left.count()
        taken = checkpoint(next_(left).groupBy("root").applyInArrow(_unlike(similarity), kind))
        found = taken.select("id", "digest")
        kept = found if kept is None else kept.unionByName(found)
        more = left.groupBy("root").count().where(F.col("count") > ROUND_TEXTS).select("root", F.ceil(F.col("count") / CHUNK_TEXTS).cast("int").alias("salts"))
        more = checkpoint(more, n // ROUND_TEXTS)
        if more.isEmpty():
            return kept
        more = _few(more, n // ROUND_TEXTS)
        rest = left.join(more, "root")
        done = _few(next_(rest.drop("shingles", "salts")).select("root", "digest"), n)
        rest = rest.join(done, ["root", "digest"], "left_anti").withColumn("salt", F.pmod(F.xxhash64("digest"), "salts").cast("int")).drop("salts")
        its = taken.join(more, "root").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        parts = rest.select(*left.columns, "salt").groupBy("root", "salt").cogroup(its.select(*left.columns, "salt").groupBy("root", "salt"))
        left = checkpoint(parts.applyInArrow(_still_unlike(similarity), kind))
        # the first similar text before each, of those left
        firsts = _in_cells(left, left, ["root"], CHUNK_TEXTS, "digest").applyInArrow(_first_alike(similarity), pairs)
        before = F.struct(F.col("of_id").isNull().alias("last"), "of_id", "of")
        firsts = checkpoint(firsts.groupBy("root", "digest").agg(F.min(before)["of"].alias("of")), n)
        free = left.join(firsts, ["root", "digest"], "left_anti")
        kept = kept.unionByName(checkpoint(free.select("id", "digest"), n))
        # of the others, those whose first similar text does not stay
        open_ = firsts.join(firsts.select("root", F.col("digest").alias("of")), ["root", "of"], "left_semi").select("root", "digest")
        left = checkpoint(left.join(open_, ["root", "digest"], "left_semi"))
        if left.isEmpty():
            return kept
        stay = free.join(left.select("root").distinct(), "root", "left_semi")
        gone = checkpoint(_in_cells(left, stay, ["root"], CHUNK_TEXTS, "digest").applyInArrow(_first_alike(similarity), pairs).select("root", "digest").distinct(), n)
        left = checkpoint(left.join(gone, ["root", "digest"], "left_anti"))


def _named(id: Column) -> Column:
    """An id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), id.cast("string")), F.lit("null"))


def _few(rows: DataFrame, most: int) -> DataFrame:
    """The rows, `most` of them or fewer, to be broadcast if their number allows."""
    rows = checkpoint(rows, most)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = 0.8, words: int = 5, budget: int = BUDGET) -> DataFrame:
    """The rows of docs with exactly their columns, less near-duplicates.

    The texts of each component of linked fingerprints are taken in order of their smallest id (nulls last, then
    the smallest digest of the text). A text goes if its set of `words`-word shingles (lower-cased; a shorter text is one) has at
    least this Jaccard similarity with that of any text kept before; else the row of its smallest id stays (of rows that
    repeat it in both, one). So a text goes only for a similar one that stays, and no two that stay in a component are
    similar. Null and empty texts are equal texts. An empty table gives no rows.

    Whole rows pass a shuffle only if the rows to be dropped are too many to be broadcast.
    """
    whole = F.coalesce(quoted(text), F.lit(""))
    by_name, by_text = _named(quoted(id)), F.md5(whole)
    node = F.xxhash64(*COLUMNS)
    rows = checkpoint(wide(docs.select(quoted(id).alias("id"), whole.alias("text")), "text", [F.col("id"), F.md5("text")]).select(
        F.col("c0").alias("id"), F.col("c1").alias("digest"), node.alias("node"), *COLUMNS))
    n = rows.count()
    prints = checkpoint(rows.select("node", *COLUMNS).dropDuplicates(["node"]), 4 * n)
    roots = checkpoint(connected(links(prints, budget), n), n)
    members = rows.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "digest", "id")
    # one row for each text: its smallest id; a row number limited to 1 is cut before the shuffle
    first = Window.partitionBy("root", "digest").orderBy(F.col("id").asc_nulls_last())
    texts = checkpoint(members.withColumn("n", F.row_number().over(first)).where("n = 1").select("root", "id", "digest"), 4 * n)
    # the texts of components with several
    several = checkpoint(texts.groupBy("root").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a < b").select("root"), n)
    wanted = texts.join(several, "root", "left_semi")
    key, mark, row, at = fresh("id"), fresh("digest"), fresh("row"), fresh("root")
    asked = _few(wanted.select(F.col("root").alias(at), _named(F.col("id")).alias(key), F.col("digest").alias(mark)), n)
    bodies = docs.select(quoted(id).alias("id"), whole.alias("text"), by_name.alias(key), by_text.alias(mark)).join(asked, [key, mark])
    sets = checkpoint(_shingled(bodies.select(F.col(at).alias("root"), "id", F.col(mark).alias("digest"), "text"), words))
    kept = texts.join(several, "root", "left_anti").select("id", "digest").unionByName(representatives(sets, similarity))
    kept = checkpoint(kept.select(_named(F.col("id")).alias(key), F.col("digest").alias(mark)), 4 * n)
    named = rows.select(_named(F.col("id")).alias(key), F.col("digest").alias(mark)).groupBy(key, mark).agg(F.count(F.lit(1)).alias("n"))
    named = checkpoint(named.join(kept.withColumn("kept", F.lit(True)), [key, mark], "left").where("kept is null or n > 1"), n)
    full = docs.select(F.struct(*(quoted(c) for c in docs.columns)).alias(row), by_name.alias(key), by_text.alias(mark))
    stay = full.join(_few(named.select(key, mark), n), [key, mark], "left_anti")
    # rows that repeat both id and text and stay: one of each
    again = named.where("kept").select(key, mark)
    if not again.isEmpty():
        once = full.join(_few(again, n), [key, mark], "left_semi").withColumn("n", F.row_number().over(Window.partitionBy(key, mark).orderBy(mark))).where("n = 1")
        stay = stay.unionByName(once.drop("n"))
    return stay.select(f"{row}.*")


def _shingled(rows: DataFrame, words: int) -> DataFrame:
    """The rows with shingles in place of text."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches):
        for batch in batches:
            for b in text_slices(batch):
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), _sets(b.column("text"), words)], names=[*names, "shingles"])
        release_memory()

    kind = ", ".join(f"{n} {t}" for n, t in rows.drop("text").dtypes)
    return rows.select(*names, "text").mapInArrow(run, f"{kind}, shingles array<long>")
