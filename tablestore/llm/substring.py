"""Substring deduplication on a log-structured index of window fingerprints.

Two texts share a window of 35 words only if they share the smallest 16-word fingerprint inside it, at the same
place (winnowing). The index therefore keeps, for every document, the 16-word fingerprints that are smallest in
some 35-word window: about one for ten words. They lie in immutable sorted runs: a row for each range of keys,
with the keys in order and the slot of documents that owns each. A run has 2 ** bits ranges, by its own size; a range of a
smaller run is cut where it meets a larger one. A new batch writes its own run, which is merge-joined with the runs of
history range by range: the batch's fingerprints that were there before, or come twice, are its hits, and are kept beside
the run. When runs grow many, they are compacted into one.

To judge documents, the hits' owners are looked up. Documents that own none stay as they are, in place. The others meet in
chunks, where the windows around hits are verified: 128-bit hashes of all 35 words are merge-joined once more, and words
covered by a window that occurs twice are removed.
"""

from __future__ import annotations

from hashlib import sha256
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablestore.llm import blocks
from tablestore.llm.common import checkpoint, grid_parts, quoted, release_memory, scratch_path, text_bytes, text_slices, trimmed

WINDOW = 35
SAMPLE = 16
#: Odd bases of the polynomial hashes.
BASE, SECOND, THIRD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
#: Occurrences that a task holds at a time, and keys of a range of a run, about.
HELD = 1_000_000
RANGE_KEYS = 250_000
#: Bytes of text for each key, about.
KEY_TEXT = 60
#: Slots up to this number are broadcast; more are joined by shuffle.
BROADCAST_SLOTS = 500_000
RUN = "bits int, bucket int, keys binary, owners binary"
HITS = "bits int, bucket int, keys binary"


class Windows:
    """The windows of some texts: where they start among all words, and hashes of parts of them."""

    def __init__(self, texts: pa.ChunkedArray, window: int, sample: int):
        self.window, self.sample = window, sample
        self.words = blocks.Words(texts)
        self.values = blocks.mix(self.words.hashes())[self.words.ids]
        n = len(self.values)
        # a window may not leave its text
        last = np.repeat(self.words.starts[1:] - window, self.words.lengths())
        self.starts = np.flatnonzero(np.arange(n) <= last)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """For every window the place of its smallest sample, the first if equal, and that sample's fingerprint."""
        grams = blocks.rolling(self.values, self.sample, BASE)
        span = self.window - self.sample + 1
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        # sparse-table minimum: the smallest of two overlapping powers of two
        low, at, size = grams, np.arange(len(grams)), 1
        while size * 2 <= span:
            second = low[size:] < low[:-size]
            low, at, size = np.where(second, low[size:], low[:-size]), np.where(second, at[size:], at[:-size]), size * 2
        s, shift = self.starts, span - size
        second = low[s + shift] < low[s]
        place = np.where(second, at[s + shift], at[s])
        return place, grams[place]

    def fingerprints(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of the whole windows at `starts`."""
        return tuple(blocks.rolling(self.values, self.window, b)[starts] for b in (SECOND, THIRD))


def _ranges(keys: np.ndarray, owners: np.ndarray | None, bits: int) -> pa.RecordBatch:
    """Rows of a run (or of hits, without owners) from rising keys: one for each range that has any."""
    edges = blocks.bucket_edges(keys, 1 << bits)
    full = np.flatnonzero(np.diff(edges))
    cut = [slice(edges[b], edges[b + 1]) for b in full]
    columns = {"bits": pa.array([bits] * len(full), pa.int32()), "bucket": pa.array(full, pa.int32()), "keys": pa.array([blocks.squeeze_sorted(keys[c]) for c in cut], pa.binary())}
    if owners is not None:
        columns["owners"] = pa.array([blocks.squeeze(owners[c]) for c in cut], pa.binary())
    return pa.RecordBatch.from_pydict(columns)


def _in_order(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By key and owner. An owner that has a fingerprint more than once has it twice: more tell nothing new."""
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    if len(keys) > 2:
        third = np.append([False, False], (keys[2:] == keys[:-2]) & (owners[2:] == owners[:-2]))
        keys, owners = keys[~third], owners[~third]
    return keys, owners


def _read_rows(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [blocks.unsqueeze_sorted(x) for x in part["keys"].to_pylist()] or [np.zeros(0, np.uint64)]
    owners = [blocks.unsqueeze(x) for x in part["owners"].to_pylist()] or [np.zeros(0, np.uint64)]
    return np.concatenate(keys), np.concatenate(owners)


def _occurrences(window: int, sample: int, bits: int):
    """Texts to run rows: every place that is some window's anchor is one occurrence, owned by its row's slot.

    A task gathers up to HELD occurrences before it deals them out, so that blocks don't get small.
    """
    def emit(batches):
        keys, owners, held = [], [], 0
        for batch in batches:
            for part in text_slices(batch):
                w = Windows(part.column("text"), window, sample)
                place, key = w.anchors()
                place, first = np.unique(place, return_index=True)
                owner = np.asarray(part.column("slot"))[np.searchsorted(w.words.starts, place, side="right") - 1]
                keys.append(key[first])
                owners.append(owner.astype(np.uint64))
                held += len(place)
                if held > HELD:
                    yield _ranges(*_in_order(np.concatenate(keys), np.concatenate(owners)), bits)
                    keys, owners, held = [], [], 0
        if held:
            yield _ranges(*_in_order(np.concatenate(keys), np.concatenate(owners)), bits)
        release_memory()
    return emit


def _finer(bits: int):
    """Rows of runs or hits with their ranges cut down to 2 ** bits ranges in all."""
    def cut(batches):
        for b in batches:
            for i, own in enumerate(b.column("bits").to_pylist()):
                row = b.slice(i, 1)
                if own == bits:
                    yield row
                else:
                    owners = blocks.unsqueeze(row.column("owners")[0].as_py()) if "owners" in b.schema.names else None
                    yield _ranges(blocks.unsqueeze_sorted(row.column("keys")[0].as_py()), owners, bits)
    return cut


def _merged(bits: int):
    """The rows of a range as one, in ranges of 2 ** bits."""
    @trimmed
    def merge(key: tuple, part: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_ranges(*_in_order(*_read_rows(part)), bits)])
    return merge


def _found(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of some rising keys are among other rising keys: a merge join of the two."""
    if not len(among):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(among, keys)
    return among[np.minimum(at, len(among) - 1)] == keys


def _hits(bits: int):
    """The keys of a batch's range that come twice in it, or in a run of history."""
    @trimmed
    def join(key: tuple, batch: pa.Table, history: pa.Table) -> pa.Table:
        keys = _read_rows(batch)[0]
        same = keys[1:] == keys[:-1]
        hit = np.append(same, False) | np.append(False, same) if len(keys) else np.zeros(0, bool)
        for run in history["keys"].to_pylist():
            hit |= _found(keys, blocks.unsqueeze_sorted(run))
        return pa.Table.from_batches([_ranges(np.unique(keys[hit]), None, bits)])
    return join


def _owners(key: tuple, runs: pa.Table, hits: pa.Table) -> pa.Table:
    """(slot, key) of a range: who owns its hits."""
    wanted = [blocks.unsqueeze_sorted(x) for x in hits["keys"].to_pylist()]
    wanted = np.unique(np.concatenate(wanted)) if wanted else np.zeros(0, np.uint64)
    slots, keys = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for data, who in zip(runs["keys"].to_pylist(), runs["owners"].to_pylist()):
        its = blocks.unsqueeze_sorted(data)
        hit = _found(its, wanted)
        keys.append(its[hit])
        slots.append(blocks.unsqueeze(who)[hit])
    slots, keys = np.concatenate(slots).view(np.int64), np.concatenate(keys).view(np.int64)
    return pa.table({"slot": pa.array(slots), "key": pa.array(keys)})


def _split(owners: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    who, first = np.unique(owners, return_index=True)
    return who, [slice(a, b) for a, b in zip(first, np.append(first[1:], len(owners)))]


def _candidates(window: int, sample: int, buckets: int):
    """The windows of a chunk whose anchor occurs more than once, as distinct 128-bit hashes, marked if repeated here."""
    @trimmed
    def find(key: tuple, part: pa.Table, answers: pa.Table) -> pa.Table:
        w = Windows(part["text"], window, sample)
        starts = np.zeros(0, np.int64)
        if answers.num_rows and len(w.starts):
            starts = w.starts[_found(w.anchors()[1], np.unique(np.asarray(answers["key"]).view(np.uint64)))]
        one, two = w.fingerprints(starts)
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        begins = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])))[:len(one)]
        twice = np.diff(np.append(begins, len(one))) > 1
        one, two = one[begins], two[begins]
        edges = blocks.bucket_edges(one, buckets)
        full = [b for b in range(buckets) if edges[b] < edges[b + 1]]
        cut = [slice(edges[b], edges[b + 1]) for b in full]
        return pa.table({
            "bucket": pa.array(full, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(full), pa.int32()),
            "one": pa.array([blocks.squeeze_sorted(one[c]) for c in cut], pa.binary()), "two": pa.array([blocks.squeeze(two[c]) for c in cut], pa.binary()),
            "twice": pa.array([np.packbits(twice[c]).tobytes() for c in cut], pa.binary()),
        })
    return find


def _verify(part: pa.Table) -> pa.Table:
    """Of all chunks' candidates of a range, to each chunk those that occur more than once."""
    one = [blocks.unsqueeze_sorted(x) for x in part["one"].to_pylist()]
    sizes = [len(x) for x in one]
    one, two = np.concatenate(one), np.concatenate([blocks.unsqueeze(x) for x in part["two"].to_pylist()])
    twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(part["twice"].to_pylist(), sizes)]).astype(bool)
    owner = np.repeat(np.asarray(part["chunk"]), sizes)
    order = np.lexsort((two, one))
    one, two, twice, owner = one[order], two[order], twice[order], owner[order]
    same = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
    many = twice | np.append(same, False) | np.append(False, same)
    one, two, owner = one[many], two[many], owner[many]
    order = np.lexsort((two, one, owner))
    one, two, owner = one[order], two[order], owner[order]
    who, cut = _split(owner)
    return pa.table({"chunk": pa.array(who, pa.int32()), "one": pa.array([blocks.squeeze_sorted(one[c]) for c in cut], pa.binary()),
                     "two": pa.array([blocks.squeeze(two[c]) for c in cut], pa.binary())})


def _among(one: np.ndarray, two: np.ndarray, found_one: np.ndarray, found_two: np.ndarray) -> np.ndarray:
    """Which pairs are among the found pairs."""
    out = np.isin(one, found_one)
    at = np.flatnonzero(out)
    a, b = np.concatenate([found_one, one[at]]), np.concatenate([found_two, two[at]])
    order = np.lexsort((b, a))
    group = np.cumsum(np.append(False, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))[:len(order)]
    hit = np.zeros(len(order), bool)
    hit[group[order < len(found_one)]] = True
    of = np.empty(len(order), np.int64)
    of[order] = group
    out[at] = hit[of[len(found_one):]]
    return out


def _cleared(window: int, sample: int, with_text: bool, part, answers: pa.Table | None):
    """The rows of some texts without the words of windows that the answers hold."""
    w = Windows(part["text"], window, sample)
    n = len(w.values)
    depth = np.zeros(n + 1, np.int64)
    if answers is not None and answers.num_rows and len(w.starts):
        found = [np.concatenate([f(x) for x in answers[c].to_pylist()]) for c, f in (("one", blocks.unsqueeze_sorted), ("two", blocks.unsqueeze))]
        starts = w.starts[_among(*w.fingerprints(w.starts), *found)]
        depth = np.bincount(starts, minlength=n + 1) - np.bincount(starts + window, minlength=n + 1)
    gone = np.cumsum(depth[:n]) > 0
    before = np.append(0, np.cumsum(gone))
    s = w.words.starts
    n_removed = before[s[1:]] - before[s[:-1]]
    kept = w.words.flat.filter(pa.array(~gone))
    left = s - before[s]
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), kept.cast(pa.string())), " ")
    out = {"row": part["row"], "n_words": pa.array(w.words.lengths(), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
           "kept_sha256": pa.array([sha256(x.as_buffer()).hexdigest() for x in texts.cast(pa.binary())], pa.string())}
    if with_text:
        whole = part["text"].combine_chunks() if isinstance(part["text"], pa.ChunkedArray) else part["text"]
        out["kept_text"] = pc.if_else(pa.array(n_removed == 0), whole, texts)
    return out


def _as_they_are(window: int, sample: int, with_text: bool):
    """Texts that own no hit, where they are."""
    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                yield pa.RecordBatch.from_pydict(_cleared(window, sample, with_text, part, None))
        release_memory()
    return run


def _remove(window: int, sample: int, with_text: bool):
    @trimmed
    def remove(key: tuple, part: pa.Table, answers: pa.Table) -> pa.Table:
        return pa.table(_cleared(window, sample, with_text, part.filter(part["new"]), answers))
    return remove


class FingerprintIndex:
    """Sorted runs of window fingerprints under a shared folder, one for each batch until they are compacted.

    `root` is any path that Spark can write. Runs and hits are named by number and never changed; a compacted run replaces
    those that went into it. Texts are not kept: whoever judges a batch against earlier ones hands in their rows
    again as `history`, of which those that own a hit of the batch are verified. One writer at a time.
    """

    #: Documents are owned by slots, so that a hot fingerprint has a bounded number of owners.
    SLOTS = 1 << 20

    def __init__(self, spark: SparkSession, root: str | None = None, window: int = WINDOW, sample: int = SAMPLE, max_runs: int = 4, range_keys: int = RANGE_KEYS):
        self.spark, self.window, self.sample, self.max_runs, self.range_keys = spark, window, sample, max_runs, range_keys
        self.root = root or scratch_path(spark, "fingerprints")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        self._files = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _named(self, kind: str) -> list[str]:
        """The paths of the finished runs or hits, oldest first."""
        if not self._files.exists(self._path):
            return []
        names = sorted(x.getPath().getName() for x in self._files.listStatus(self._path))
        jvm = self.spark.sparkContext._jvm
        return [f"{self.root}/{n}" for n in names if n.startswith(kind) and self._files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}/_SUCCESS"))]

    def runs(self) -> list[str]:
        return self._named("run-")

    def _next(self, kind: str) -> str:
        old = self._named(kind)
        return f"{self.root}/{kind}{int(old[-1].rpartition('-')[2]) + 1 if old else 0:08d}"

    def _bits(self, keys: int) -> int:
        return max(0, ceil(log2(max(1, keys / self.range_keys))))

    def _read(self, paths: list[str], kind: str, bits: int | None = None) -> DataFrame:
        """Rows of runs or hits, in ranges of 2 ** bits if given."""
        rows = self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)
        return rows if bits is None else rows.mapInArrow(_finer(bits), kind)

    def _finest(self, *rows: DataFrame) -> int:
        return max(x.agg(F.max("bits")).first()[0] or 0 for x in rows)

    def _write(self, rows: DataFrame, bits: int) -> str:
        """A run with one row for each range, from rows of the same ranges."""
        path = self._next("run-")
        parts = max(1, min(1 << bits, int(self.spark.conf.get("spark.sql.shuffle.partitions")))) if bits < 12 else 1 << bits
        rows.repartitionById(parts, "bucket").groupBy("bucket").applyInArrow(_merged(bits), RUN).write.mode("overwrite").parquet(path)
        return path

    def _rows(self, docs: DataFrame, id: str, text: str, row) -> DataFrame:
        slot = F.pmod(F.xxhash64(quoted(id), quoted(text)), F.lit(self.SLOTS))
        return docs.select(slot.alias("slot"), F.coalesce(quoted(text), F.lit("")).alias("text"), row.alias("row"))

    def append(self, batch: DataFrame, id: str = "doc_id", text: str = "text", size: int | None = None) -> int:
        """Write the batch's run, and its hits in the runs there are; compact if there are more than max_runs.

        `size`: bytes of the batch's texts, if known. Returns the batch's number. An empty batch has an empty run.
        """
        rows = self._rows(batch, id, text, F.lit(None)).select("slot", "text")
        bits = self._bits((text_bytes(rows) if size is None else size) // KEY_TEXT)
        old = self.runs()
        new = self._write(rows.mapInArrow(_occurrences(self.window, self.sample, bits), RUN), bits)
        mine, history = self._read([new], RUN), self._read(old, RUN)
        finest = self._finest(mine, history)
        parts = max(1, min(1 << finest, 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")))) if finest < 12 else 1 << finest
        mine, history = (x.mapInArrow(_finer(finest), RUN).repartitionById(parts, "bucket") for x in (mine, history))
        path = self._next("hits-")
        mine.groupBy("bucket").cogroup(history.groupBy("bucket")).applyInArrow(_hits(finest), HITS).write.mode("overwrite").parquet(path)
        if len(self.runs()) > self.max_runs:
            self.compact()
        return int(path.rpartition("-")[2])

    def compact(self) -> None:
        """Merge all runs into one. The old ones go only when the new one is complete."""
        old = self.runs()
        if len(old) > 1:
            finest = self._finest(self._read(old, RUN))
            bits = max(finest, self._bits(sum((1 << finest) * self.range_keys // 2 for _ in old)))
            self._write(self._read(old, RUN, bits), bits)
            for path in old:
                self._files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)

    def judge(self, batch: DataFrame, history: DataFrame | None = None, id: str = "doc_id", text: str = "text", carry: list[str] | None = None, with_text: bool = False,
              numbers: list[int] | None = None) -> DataFrame:
        """One row for each row of the batch: `row` (struct of the columns in `carry`, id alone by default), n_words,
        n_removed, kept_sha256 and, if asked, kept_text.

        The rows must have been appended, in the batches of these numbers (None: all there are), and `history` must hold the
        rows of all earlier batches. A word goes if a window that covers it starts anywhere else in batch or history, in
        the same text included. Null and empty texts have no words; texts shorter than the window lose none; repeated rows
        remove each other's windows; an empty batch gives no rows. kept_text is the text itself if nothing was removed,
        and else its kept words joined by one space.
        """
        spark = self.spark
        row = F.struct(*(quoted(c) for c in carry or [id]))
        whole = self._rows(batch, id, text, row).withColumn("new", F.lit(True))
        kind = whole.schema["row"].dataType
        if history is not None:
            whole = whole.unionByName(self._rows(history, id, text, F.lit(None).cast(kind)).withColumn("new", F.lit(False)))
        out = T.StructType([T.StructField("row", kind), *(T.StructField(c, t) for c, t in (
            ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), ("kept_text", T.StringType()))[:3 + with_text])])
        wanted = [p for p in self._named("hits-") if numbers is None or int(p.rpartition("-")[2]) in numbers]
        finest = self._finest(self._read(self.runs(), RUN), self._read(wanted, HITS))
        parts = max(1, min(1 << finest, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))) if finest < 12 else 1 << finest
        runs, hits = self._read(self.runs(), RUN, finest).repartitionById(parts, "bucket"), self._read(wanted, HITS, finest).repartitionById(parts, "bucket")
        found = checkpoint(runs.groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInArrow(_owners, "slot long, key long"))
        slots = checkpoint(found.select("slot").distinct(), self.SLOTS)
        slots = F.broadcast(slots) if slots.count() <= BROADCAST_SLOTS else slots
        calm = whole.where("new").join(slots, "slot", "left_anti").select("text", "row").mapInArrow(_as_they_are(self.window, self.sample, with_text), out)
        owning = whole.join(slots, "slot", "left_semi")
        parts = min(grid_parts(spark, text_bytes(owning)), self.SLOTS)
        owning = owning.select((F.col("slot") % parts).cast("int").alias("chunk"), "text", "row", "new").repartitionById(parts, "chunk")
        found = found.select((F.col("slot") % parts).cast("int").alias("chunk"), "key").repartitionById(parts, "chunk")
        asked = owning.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(
            _candidates(self.window, self.sample, parts), "bucket int, chunk int, one binary, two binary, twice binary")
        verified = asked.repartitionById(parts, "bucket").groupBy("bucket").applyInArrow(_verify, "chunk int, one binary, two binary")
        judged = owning.groupBy("chunk").cogroup(verified.repartitionById(parts, "chunk").groupBy("chunk")).applyInArrow(_remove(self.window, self.sample, with_text), out)
        return judged.unionByName(calm)


def dedupe(docs: DataFrame, id: str = "doc_id", text: str = "text", carry: list[str] | None = None, with_text: bool = False,
           window: int = WINDOW, sample: int = SAMPLE, batches: int = 1, max_runs: int = 4) -> DataFrame:
    """Judge all rows of docs on a fresh index, to which they are appended in `batches` batches. See FingerprintIndex.judge."""
    index = FingerprintIndex(docs.sparkSession, window=window, sample=sample, max_runs=max_runs)
    size = text_bytes(docs, text) // batches
    for i in range(batches):
        part = docs if batches == 1 else docs.where(F.pmod(F.xxhash64(quoted(id), F.lit(1)), F.lit(batches)) == i)
        index.append(part, id, text, size)
    return index.judge(docs, None, id, text, carry, with_text)
