"""Language-model scores from a weighted backoff automaton whose counts stay distributed.

The model is a trigram model over add-one unigrams: p(w | h) = (c(hw) + K * p(w | h')) / (c(h) + K), a Dirichlet prior
of K words for each order, centred on the shorter history h'; below is p(w) = (c(w) + 1) / (N + V + 1). As an automaton,
the start of a text, every known word and every known pair are states, and a state's arcs are the words seen after it. An arc
leads to the state of its last two words; the failure arc of a pair leads to its last word, that of a word to the root,
at the price log10(K / (c(h) + K)); the root's arcs are all words, known or not. The probabilities of a state add up to 1.

No task holds the whole model. Texts are dealt into chunks. Each chunk sends its distinct words and pairs, as sorted
64-bit keys with its own training counts, to the ranges of keys that own them; each owner adds up all chunks'
counts and answers every chunk in the order in which it asked. A triple whose first or last pair occurs in no other
chunk can't occur there either, so that its count is known; the others are asked for in a second exchange.
Then the chunk builds the part of the automaton that its own texts can reach and traverses it. What is sent grows
with the corpus. Two n-grams share a key with a chance of about n * n / 2**65 for n distinct n-grams.
"""

from __future__ import annotations

import struct
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablestore.llm import blocks
from tablestore.llm.common import grid_parts, text_bytes, trimmed

#: Weight of the shorter history below pairs and below triples, in words.
PRIOR_WORDS = (100.0, 10.0)
#: Keys of the text's end as a word, and of its start as a state; words hash with seed 0.
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
PAIR, TRIPLE = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xFF51AFD7ED558CCD)
BLOCK = "bucket int, chunk int, level int, data binary"


class Chunk:
    """The n-grams of some texts: keys by position, the distinct keys in order, and how often each is learned from here.

    Position p of a text with n words is word p, and the end for p = n. The start state's key counts texts and
    is kept with the pairs, so that it is no word. A triple is a pair and the word after it; the start counts as a word.
    """

    def __init__(self, texts: pa.ChunkedArray, learn: np.ndarray):
        w = blocks.Words(texts, lower=True)
        hashes = blocks.mix(np.append(w.hashes(), END))
        self.tokens = w.lengths() + 1
        self.stops = np.cumsum(self.tokens)
        self.begins = self.stops - self.tokens
        ids = np.full(int(self.tokens.sum()), len(hashes) - 1)
        inside = np.ones(len(ids), bool)
        inside[self.stops - 1] = False
        ids[inside] = w.ids
        words = hashes[ids]
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[self.begins] = START
        pairs = blocks.mix(before * PAIR + words)
        self.learned = np.repeat(learn, self.tokens)
        self.word_keys, place = np.unique(hashes, return_inverse=True)
        self.word_at = place[ids].astype(np.int32)
        self.pair_keys, place = np.unique(np.append(pairs, START), return_inverse=True)
        self.start_at, self.pair_at = int(place[-1]), place[:-1].astype(np.int32)
        self.word_counts = self._counts(self.word_at, self.learned, len(self.word_keys))
        self.pair_counts = self._counts(self.pair_at, self.learned, len(self.pair_keys))
        self.pair_counts[self.start_at] += np.uint64(learn.sum())

    @staticmethod
    def _counts(at: np.ndarray, learned: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(at[learned], minlength=n).astype(np.uint64)

    def pair_states(self) -> tuple[np.ndarray, np.ndarray]:
        """The state before each pair (a word's number, or the number of words for the start) and its word."""
        came = np.empty_like(self.word_at)
        came[1:] = self.word_at[:-1]
        came[self.begins] = len(self.word_keys)
        state, word = np.zeros(len(self.pair_keys), np.int32), np.zeros(len(self.pair_keys), np.int32)
        state[self.pair_at], word[self.pair_at] = came, self.word_at
        return state, word

    def find_triples(self) -> None:
        """The distinct triples: keys, counts, and the numbers of their first and last pair and their word."""
        later = np.ones(len(self.word_at), bool)
        later[self.begins] = False
        at = np.flatnonzero(later)
        keys = blocks.mix(self.pair_keys[self.pair_at[at - 1]] * TRIPLE + self.word_keys[self.word_at[at]])
        self.triple_keys, first, place = np.unique(keys, return_index=True, return_inverse=True)
        self.triple_counts = self._counts(place, self.learned[at], len(self.triple_keys))
        at = at[first]
        self.first_pair, self.last_pair, self.triple_word = self.pair_at[at - 1], self.pair_at[at], self.word_at[at]

    def unsure(self, elsewhere: np.ndarray) -> np.ndarray:
        """Which triples other chunks may have, by which pairs they have: a triple needs both its pairs."""
        return elsewhere[self.first_pair] & elsewhere[self.last_pair]


def _as_array(kind: str, numbers: np.ndarray) -> array:
    out = array(kind)
    out.frombytes(numbers.astype(kind).tobytes())
    return out


class Automaton:
    """States, arcs and failure arcs that the texts of a chunk can reach.

    States are numbered: the chunk's words, `start`, then its pairs; ROOT is below all. The arcs of state s are numbers first[s]
    to first[s + 1], by rising `word`; an arc has a log10 `weight` and leads to the state `to`. fail[s] is the weight of the
    failure arc from s to fail_to[s]; root[w] is the weight of the root's arc for word w, which leads to w's state. The
    failure arc of an unknown word or pair is free.
    """

    ROOT = -1

    def __init__(self, chunk: Chunk, word_counts: np.ndarray, pair_counts: np.ndarray, triple_counts: np.ndarray, total: int, distinct: int,
                 priors: tuple[float, float] = PRIOR_WORDS):
        one, two = priors
        n_words = self.start = len(word_counts)
        pair_state = n_words + 1
        p = (word_counts + 1.0) / (total + 1.0 * (distinct + 1))
        after = np.append(word_counts, pair_counts[chunk.start_at]).astype(np.float64)
        state, word = chunk.pair_states()
        below = (pair_counts + one * p[word]) / (after[state] + one)
        weight = (triple_counts + two * below[chunk.last_pair]) / (pair_counts[chunk.first_pair] + two)
        known = pair_counts > 0
        known[chunk.start_at] = False
        known, seen = np.flatnonzero(known), np.flatnonzero(triple_counts > 0)
        states = np.concatenate([state[known], pair_state + chunk.first_pair[seen]])
        words = np.concatenate([word[known], chunk.triple_word[seen]])
        keys = states.astype(np.int64) * n_words + words
        order = np.argsort(keys)
        self.keys = keys[order]
        self.first = _as_array("q", np.searchsorted(states[order], np.arange(pair_state + len(pair_counts) + 1)))
        self.word = _as_array("i", words[order])
        self.weight = _as_array("d", np.log10(np.concatenate([below[known], weight[seen]])[order]))
        self.to = _as_array("i", pair_state + np.concatenate([known, chunk.last_pair[seen]])[order])
        self.fail = _as_array("d", np.log10(np.concatenate([one / (after + one), two / (pair_counts + two)])))
        self.fail_to = _as_array("i", np.concatenate([np.full(pair_state, self.ROOT), word]))
        self.root = _as_array("d", np.log10(p))

    def traverse_all(self, chunk: Chunk, pair_counts: np.ndarray) -> np.ndarray:
        """Each position's weight on the passes over all of the chunk's texts, as `traverse` adds them up.

        A pass is in the state of the last two words where that pair is known, else of the last word, whatever came before. So
        all positions are taken at once: each looks for its arc, and those that have none take their failure arcs.
        """
        weight, to, fail, root = (np.frombuffer(x, kind) for x, kind in ((self.weight, "d"), (self.to, "i"), (self.fail, "d"), (self.root, "d")))
        fail_to = np.frombuffer(self.fail_to, "i")
        word, n_words = chunk.word_at, self.start
        after = np.where(pair_counts[chunk.pair_at] > 0, n_words + 1 + chunk.pair_at, word)
        state = np.empty_like(after)
        state[1:] = after[:-1]
        state[chunk.begins] = n_words
        out, open_ = np.zeros(len(word)), np.arange(len(word))
        while len(open_):
            key = state.astype(np.int64) * n_words + word[open_]
            arc = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            hit = self.keys[arc] == key if len(self.keys) else np.zeros(len(key), bool)
            arc, done = arc[hit], open_[hit]
            if (to[arc] != after[done]).any():
                raise ValueError("an arc leads to another state than its last words'")
            out[done] += weight[arc]
            open_, state = open_[~hit], state[~hit]
            out[open_] += fail[state]
            state = fail_to[state]
            lost = state == self.ROOT
            out[open_[lost]] += root[word[open_[lost]]]
            open_, state = open_[~lost], state[~lost]
        return out

    def traverse(self, words: list[int], state: int | None = None) -> float:
        """One pass from left to right, from the start if no state is given: the state is carried, weights add up.

        A word takes failure arcs up to a state that has an arc for it, and that arc.
        """
        first, arc_word, weight, to, fail, fail_to, root = self.first, self.word, self.weight, self.to, self.fail, self.fail_to, self.root
        state, score = self.start if state is None else state, 0.0
        for word in words:
            while state >= 0:
                low, high = first[state], first[state + 1]
                if low < high:
                    arc = low if arc_word[low] == word else bisect_left(arc_word, word, low, high)
                    if arc < high and arc_word[arc] == word:
                        score += weight[arc]
                        state = to[arc]
                        break
                score += fail[state]
                state = fail_to[state]
            else:
                score += root[word]
                state = word
        return score


def _block_rows(chunk: int, level: int, data: list[tuple[int, bytes]]) -> pa.Table:
    n = len(data)
    return pa.table({"bucket": pa.array([b for b, _ in data], pa.int32()), "chunk": pa.array([chunk] * n, pa.int32()), "level": pa.array([level] * n, pa.int32()),
                     "data": pa.array([x for _, x in data], pa.binary())})


def _asked(level_keys: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> list[list[bytes]]:
    """For each range the keys and counts of each level in it."""
    edges = [blocks.bucket_edges(keys, buckets) for keys, _ in level_keys]
    return [[f(x[e[b]:e[b + 1]]) for (keys, counts), e in zip(level_keys, edges) for f, x in ((blocks.squeeze_sorted, keys), (blocks.squeeze, counts))] for b in range(buckets)]


def _ask(buckets: int):
    @trimmed
    def ask(key: tuple, part: pa.Table) -> pa.Table:
        chunk = Chunk(part["text"], np.asarray(part["learn"]))
        # every range is asked, for its totals
        pieces = _asked([(chunk.word_keys, chunk.word_counts), (chunk.pair_keys, chunk.pair_counts)], buckets)
        return _block_rows(key[0].as_py(), 1, [(b, _join(x)) for b, x in enumerate(pieces)])
    return ask


def _ask_triples(buckets: int):
    @trimmed
    def ask(key: tuple, part: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(part["text"], np.asarray(part["learn"]))
        elsewhere = _sums(chunk, answers)[2]
        chunk.find_triples()
        unsure = chunk.unsure(elsewhere)
        keys, counts = chunk.triple_keys[unsure], chunk.triple_counts[unsure]
        full = np.diff(blocks.bucket_edges(keys, buckets)) > 0
        return _block_rows(key[0].as_py(), 2, [(b, _join(x)) for b, x in enumerate(_asked([(keys, counts)], buckets)) if full[b]])
    return ask


def _join(pieces: list[bytes]) -> bytes:
    return struct.pack(f"<{len(pieces)}I", *map(len, pieces)) + b"".join(pieces)


def _cut(data: bytes, n: int) -> list[bytes]:
    ends = np.cumsum(struct.unpack_from(f"<{n}I", data)) + 4 * n
    return [data[a:b] for a, b in zip([4 * n, *ends[:-1]], ends)]


def _sum(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The sums by distinct key, and for each list its keys' sums and which of its keys other lists have."""
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(place, np.concatenate(counts).astype(np.float64), len(distinct)).astype(np.uint64)
    shared = np.bincount(place, minlength=len(distinct)) > 1
    ends = np.cumsum([len(k) for k in keys])[:-1]
    return sums, np.split(sums[place], ends), np.split(shared[place], ends)


@trimmed
def _answer(key: tuple, part: pa.Table) -> pa.Table:
    """The sums of a range, for each chunk in its order, with the range's totals."""
    asked = [_cut(x, 4) for x in part["data"].to_pylist()]
    word_sums, words, _ = _sum([blocks.unsqueeze_sorted(x[0]) for x in asked], [blocks.unsqueeze(x[1]) for x in asked])
    _, pairs, shared = _sum([blocks.unsqueeze_sorted(x[2]) for x in asked], [blocks.unsqueeze(x[3]) for x in asked])
    totals = struct.pack("<2Q", int(word_sums.sum()), int((word_sums > 0).sum()))
    data = [_join([totals, blocks.squeeze(w), blocks.squeeze(p), np.packbits(s).tobytes()]) for w, p, s in zip(words, pairs, shared)]
    return part.set_column(part.schema.get_field_index("data"), "data", pa.array(data, pa.binary()))


@trimmed
def _answer_triples(key: tuple, part: pa.Table) -> pa.Table:
    asked = [_cut(x, 2) for x in part["data"].to_pylist()]
    _, sums, _ = _sum([blocks.unsqueeze_sorted(x[0]) for x in asked], [blocks.unsqueeze(x[1]) for x in asked])
    return part.set_column(part.schema.get_field_index("data"), "data", pa.array([_join([blocks.squeeze(x)]) for x in sums], pa.binary()))


def _got(answers: pa.Table, level: int, pieces: int) -> list[list[bytes]]:
    """The pieces of a level's answers, by rising range."""
    return [_cut(x, pieces) for x in answers.filter(pc.equal(answers["level"], level)).sort_by("bucket")["data"].to_pylist()]


def _sums(chunk: Chunk, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """The sums of the chunk's words and pairs, which pairs other chunks have, and the number of all and of distinct training tokens."""
    got = _got(answers, 1, 4)
    words, pairs = ([blocks.unsqueeze(x[i]) for x in got] for i in (1, 2))
    elsewhere = np.concatenate([np.unpackbits(np.frombuffer(x[3], np.uint8), count=len(p)) for x, p in zip(got, pairs)]).astype(bool)
    words, pairs = np.concatenate(words), np.concatenate(pairs)
    if len(words) != len(chunk.word_keys) or len(pairs) != len(chunk.pair_keys):
        raise ValueError("the texts of a chunk changed while they were scored")
    total, distinct = (sum(x) for x in zip(*(struct.unpack("<2Q", x[0]) for x in got)))
    return words, pairs, elsewhere, total, distinct


def _score(priors: tuple[float, float]):
    @trimmed
    def score(key: tuple, part: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(part["text"], np.asarray(part["learn"]))
        word_counts, pair_counts, elsewhere, total, distinct = _sums(chunk, answers)
        chunk.find_triples()
        unsure, sums = chunk.unsure(elsewhere), [blocks.unsqueeze(x[0]) for x in _got(answers, 2, 1)]
        triple_counts = chunk.triple_counts
        if sum(map(len, sums)) != unsure.sum():
            raise ValueError("the texts of a chunk changed while they were scored")
        if sums:
            triple_counts[unsure] = np.concatenate(sums)
        model = Automaton(chunk, word_counts, pair_counts, triple_counts, total, distinct, priors)
        logs = np.log10((word_counts + 1.0) / (total + 1.0 * (distinct + 1)))
        # every text has a token, its end
        n_known, base, scores = (np.add.reduceat(x, chunk.begins) for x in ((word_counts > 0)[chunk.word_at].astype(np.int64), logs[chunk.word_at], model.traverse_all(chunk, pair_counts)))
        return pa.table({"id": part["id"], "held_out": pc.invert(part["learn"]), "n_tokens": pa.array(chunk.tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
                         "train_tokens": pa.array([total] * len(chunk.tokens), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(scores, pa.float64())})
    return score


def score(docs: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", priors: tuple[float, float] = PRIOR_WORDS) -> DataFrame:
    """One row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows where `learn` is true (null: false). Null texts count as empty: one token, the
    end. base_score is the add-one unigram score. Repeated rows are learned and scored as often as
    they occur. Without training rows every token has p = 1 / 1 and an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    # a task for each chunk and each range, whatever the session's number of partitions is
    parts = grid_parts(spark, text_bytes(rows), block=64 << 10)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(parts)).cast("int")).repartitionById(parts, "chunk")
    asked = rows.groupBy("chunk").applyInArrow(_ask(parts), BLOCK).repartitionById(parts, "bucket")
    answers = asked.groupBy("bucket").applyInArrow(_answer, BLOCK)
    counted = rows.groupBy("chunk").cogroup(answers.repartitionById(parts, "chunk").groupBy("chunk"))
    triples = counted.applyInArrow(_ask_triples(parts), BLOCK).repartitionById(parts, "bucket").groupBy("bucket").applyInArrow(_answer_triples, BLOCK)
    answers = answers.unionByName(triples).repartitionById(parts, "chunk")
    kind = f"id {dict(rows.dtypes)['id']}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(priors), kind).withColumnRenamed("id", id)


def in_training(id: Column) -> Column:
    """The fixed split: crc32 of the id as text, modulo 7, is not 2; a null id is in training."""
    return F.coalesce(F.crc32(id.cast("string")) % 7 != 2, F.lit(True))
