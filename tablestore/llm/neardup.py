"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints within `bits` differing bits agree in at least one of bits + 1 blocks. For each block, the
distinct fingerprints are grouped by its value; a group with many members is grouped again by blocks of its
remaining bits, so that no group grows with the data. Each task sorts its groups into binary tries and joins them
with themselves: pairs of nodes go down together, differing bits add up, and a pair over the budget is pruned.
A task reports only which fingerprints it found connected, and components are joined up across tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablestore.llm.common import checkpoint, shuffle_partitions, text_slices
from tablestore.llm.components import connected

SHINGLE = 3
BITS = 2
#: Groups of more members are divided again, as often as there are levels.
HOT_GROUP = 1024
LEVELS = 3
#: Hot groups up to this number are broadcast for the split; more are joined by shuffle.
BROADCAST_GROUPS = 20_000
#: Rows up to this number are broadcast to find or drop them; more are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Rows of a trie task, about, and node pairs held at a time.
TASK_ROWS = 250_000
FRONTIER = 500_000
FULL = (1 << 64) - 1


def fingerprint_many(texts: list, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text as an unsigned number; no words: 0."""
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    hashes, sizes, where = [], [], []

    def flush() -> None:
        if sizes:
            h = np.array(hashes, np.uint64)
            starts = np.append(0, np.cumsum(sizes))[:-1]
            bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            major = ones * 2 > np.array(sizes)[:, None]
            out[where] = np.packbits(major, axis=1).view(">u8").reshape(-1).astype(np.uint64)
        hashes.clear(), sizes.clear(), where.clear()

    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        if not words:
            continue
        line = b" ".join(words)
        if len(words) <= shingle:
            found = [digest(line, 42)]
        else:
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = np.append(0, ends)[: len(words) - shingle + 1].tolist()
            found = [digest(line[a:b], 42) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())]
        hashes += found
        sizes.append(len(found))
        where.append(i)
        if len(hashes) > 200_000:
            flush()
    flush()
    return out


def fingerprints(docs: DataFrame, text: str = "text", carry: list[Column] = (), shingle: int = SHINGLE) -> DataFrame:
    """fingerprint (its 64 bits as a long) and the carried columns, a row for each row of docs."""
    names = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(*(c.alias(n) for c, n in zip(carry, names)), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            for b in text_slices(batch):
                made = pa.array(fingerprint_many(b.column("text").to_pylist(), shingle).view(np.int64))
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), made], names=[*names, "fingerprint"])

    kind = [f"{n} {t}" for n, t in rows.drop("text").dtypes] + ["fingerprint long"]
    return rows.mapInArrow(run, ", ".join(kind))


def _blocks(positions: list[int], n: int) -> list[int]:
    """Masks of n blocks of the bit positions, as equal as can be."""
    cuts = [len(positions) * i // n for i in range(n + 1)]
    return [sum(1 << p for p in positions[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def paths(bits: int, levels: int) -> list[dict[int, list[tuple[int, int]]]]:
    """By level: the paths that lead on from each path, as (path, mask of all bits that agree so far)."""
    out, open_, n = [], {0: 0}, 0
    for _ in range(levels):
        level, found = {}, {}
        for path, mask in open_.items():
            left = [p for p in range(64) if not mask >> p & 1]
            level[path] = []
            for block in _blocks(left, bits + 1):
                n += 1
                level[path].append((n, mask | block))
                found[n] = mask | block
        out.append(level)
        open_ = found
    return out


def _grouped(fps: DataFrame, bits: int) -> DataFrame:
    """(group, fingerprint): every pair within the budget shares a group; groups are small, see HOT_GROUP."""
    levels = paths(bits, LEVELS)
    rows = fps.select("fingerprint", F.lit(0).alias("path"))
    done = None
    for i, level in enumerate(levels):
        # the paths of a level are numbered in a row; one literal holds what follows each
        table = F.array(*(F.array(*(F.struct(F.lit(n).alias("path"), F.lit(_signed(mask)).alias("mask")) for n, mask in level[p])) for p in sorted(level)))
        following = F.get(table, F.col("path") - min(level))
        rows = rows.select("fingerprint", F.explode(following).alias("s")).select(
            "fingerprint", F.col("s.path").alias("path"), F.xxhash64("s.path", F.col("fingerprint").bitwiseAND(F.col("s.mask"))).alias("group"))
        if i + 1 < len(levels):
            hot = checkpoint(rows.groupBy("group").count().where(F.col("count") > HOT_GROUP).select(F.col("group").alias("hot")), 0)
            n = hot.count()
        if i + 1 == len(levels) or not n:
            out = rows.select("group", "fingerprint")
            return out if done is None else done.unionByName(out)
        hot = F.broadcast(hot) if n <= BROADCAST_GROUPS else hot
        cold = rows.join(hot, F.col("group") == F.col("hot"), "left_anti").select("group", "fingerprint")
        done = cold if done is None else done.unionByName(cold)
        rows = rows.join(hot, F.col("group") == F.col("hot"), "left_semi").select("fingerprint", "path")
    return done


def trie_links(groups: np.ndarray, fps: np.ndarray, bits: int):
    """Pairs (i, j) of positions within a group whose fingerprints differ in at most `bits` bits, in pieces.

    A fingerprint is a number of 64 bits, or a row of several. groups and fps are sorted by group, then by fingerprint,
    without repeats. A node of a group's trie is a range of positions that share a beginning of their bits.
    """
    fps = fps.reshape(len(fps), -1)
    n, top = len(fps), 64 * fps.shape[1] - 1
    begins = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if n else np.zeros(0, np.int64)
    ends = np.append(begins[1:], n)
    real = ends - begins > 1
    a = begins[real], ends[real]
    stack = [(0, a[0], a[1], a[0], a[1], np.zeros(len(a[0]), np.int16))]
    ones = {}

    def split(bit: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if bit not in ones:
            ones.clear()
            ones[bit] = np.append(0, np.cumsum((fps[:, bit // 64] >> np.uint64(63 - bit % 64)) & np.uint64(1), dtype=np.int64))
        return hi - (ones[bit][hi] - ones[bit][lo])

    while stack:
        bit, alo, ahi, blo, bhi, far = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack += [(bit, *(x[:half] for x in (alo, ahi, blo, bhi, far))), (bit, *(x[half:] for x in (alo, ahi, blo, bhi, far)))]
            continue
        # pairs of single fingerprints need no further descent
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            i, j = alo[single], blo[single]
            other = i != j
            i, j = i[other], j[other]
            near = np.bitwise_count(fps[i] ^ fps[j]).sum(1, dtype=np.int64) <= bits
            if near.any():
                yield i[near], j[near]
            alo, ahi, blo, bhi, far = (x[~single] for x in (alo, ahi, blo, bhi, far))
        if not len(alo) or bit > top:
            continue
        amid, bmid = split(bit, alo, ahi), split(bit, blo, bhi)
        itself = alo == blo
        parts = [(alo, amid, blo, bmid, far), (amid, ahi, bmid, bhi, far), (alo, amid, bmid, bhi, far + 1),
                 tuple(x[~itself] for x in (amid, ahi, blo, bmid, far + 1))]
        new = [np.concatenate(x) for x in zip(*parts)]
        live = (new[1] > new[0]) & (new[3] > new[2]) & (new[4] <= bits) & ~((new[0] == new[2]) & (new[1] - new[0] == 1))
        if live.any():
            stack.append((bit + 1, *(x[live] for x in new)))


def join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give the members of linked positions their least label; labels point to positions."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (up := labels[labels]).tobytes() != labels.tobytes():
            labels[:] = up


def _trie_task(bits: int, columns: tuple[str, ...] = ("fingerprint",), node: str = "fingerprint"):
    """Rows of groups to links (u, v) of the nodes that the task finds connected: a spanning set, not all pairs."""
    def run(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        group, name = (np.concatenate([np.asarray(b.column(c)) for b in tables]) for c in ("group", node))
        fp = np.stack([np.concatenate([np.asarray(b.column(c)) for b in tables]).view(np.uint64) for c in columns], 1)
        order = np.lexsort((*fp.T[::-1], group))
        group, fp, name = group[order], fp[order], name[order]
        new = np.append(True, (group[1:] != group[:-1]) | (fp[1:] != fp[:-1]).any(1))
        group, fp, name = group[new], fp[new], name[new]
        distinct, at = np.unique(name, return_inverse=True)
        labels = np.arange(len(distinct))
        for i, j in trie_links(group, fp, bits):
            join_labels(labels, at[i], at[j])
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        yield pa.RecordBatch.from_arrays([pa.array(distinct[moved]), pa.array(distinct[labels[moved]])], names=["u", "v"])
    return run


def classes(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(fingerprint, root) for each distinct fingerprint of `fps`; the root stands for its component."""
    fps = checkpoint(fps.select("fingerprint").distinct())
    rows = checkpoint(_grouped(fps, bits))
    several = rows.count()
    parts = max(shuffle_partitions(fps.sparkSession), -(-several // TASK_ROWS))
    links = rows.repartition(parts, "group").mapInArrow(_trie_task(bits), "u long, v long")
    roots = connected(links, several // (bits + 1))
    return fps.join(roots, fps.fingerprint == roots.node, "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row for each row of docs: id, fingerprint (16 hex digits), component_id.

    Null, empty and wordless texts have fingerprint zero, which links like any other; a text of fewer words than
    the shingle is one shingle. component_id is the smallest id of the rows connected by links, null if all
    their ids are null. Repeated rows get equal results.
    """
    rows = checkpoint(fingerprints(docs, text, [F.col(id)], shingle)).select(F.col("c0").alias("id"), "fingerprint")
    roots = checkpoint(classes(rows, bits))
    least = rows.groupBy("fingerprint").agg(F.min("id").alias("least")).join(roots, "fingerprint")
    of_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = least.join(of_root, "root").select("fingerprint", "component_id")
    hexed = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return rows.join(of_print, "fingerprint").select(F.col("id").alias(id), hexed.alias("fingerprint"), "component_id")
