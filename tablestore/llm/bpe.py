"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

For each start in a piece of text an Aho-Corasick automaton gives the longest token. The encoder takes it if it is
compatible with the token before, that is, if byte-pair merges of the two tokens' bytes would give just these
two; else it tries the next shorter token, and where none is left it goes back one token. A place from which no
encoding continues is marked and never entered again, so the work is linear and the result is that of the merges.
"""

from __future__ import annotations

import hashlib
import json

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablestore.llm.common import quoted, release_memory, text_slices

#: Fixed value: the public pattern that cuts text into pieces before byte-level merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces and token pairs that a worker remembers, some 70 MB each at most.
PIECE_MEMORY, PAIR_MEMORY = 200_000, 400_000


def byte_alphabet() -> dict[str, int]:
    """The visible character by which byte-level vocabularies write each byte, to the byte.

    Printable bytes other than white space and the soft hyphen stand for themselves; the others take the
    characters from 256 on, in order.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary from the text of a tokenizers JSON file.

    Inside, tokens are numbered by rank: the single bytes first, then the merges in order.
    """

    def __init__(self, text: str):
        spec = json.loads(text)
        model, kind = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or spec["normalizer"] or spec["post_processor"]:
            raise ValueError("only byte-level BPE without normaliser, prefix space and post-processor is known")
        alphabet = byte_alphabet()
        ids = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        names = [c for c in alphabet if c in ids]
        rank = {c: i for i, c in enumerate(names)}
        if len(names) != 256:
            raise ValueError("a byte has no token")
        self.parts = [(i, i) for i in range(256)]
        self.merged = {}
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if left + right not in rank:
                rank[left + right] = len(names)
                names.append(left + right)
                self.parts.append((rank[left], rank[right]))
            self.merged.setdefault((rank[left], rank[right]), rank[left + right])
        self.bytes = [bytes(alphabet[c] for c in n) for n in names]
        self.length = [len(b) for b in self.bytes]
        self.id = [ids[n] for n in names]
        self.matcher = ahocorasick.Automaton()
        for i, b in enumerate(self.bytes):
            self.matcher.add_word(b.decode("latin-1"), i)
        self.matcher.make_automaton()
        by_bytes = {b: i for i, b in enumerate(self.bytes)}
        #: The next shorter token that begins a token, or -1.
        self.shorter = [next((by_bytes[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in by_bytes), -1) for b in self.bytes]
        self.compatible: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[str, bytes]] = {}
        # the offset table of the decoder, by id
        table = dict(zip(self.id, self.bytes)) | {i: s.encode() for s, i in self.special.items()}
        sizes = np.zeros(max(table) + 1, np.int64)
        for i, b in table.items():
            sizes[i] = len(b)
        self.offsets = np.append(0, np.cumsum(sizes))
        self.blob = np.frombuffer(b"".join(table.get(i, b"") for i in range(len(sizes))), np.uint8)

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens together gives just these two tokens.

        The later merge of the two is undone, again and again; if two tokens that meet at the border would
        merge before the merge undone last, they would have merged across it.
        """
        pair = (left, right)
        known = self.compatible.get(pair)
        if known is None:
            if len(self.compatible) >= PAIR_MEMORY:
                self.compatible.clear()
            known = self.compatible[pair] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        merged, parts = self.merged, self.parts
        # a merge counts from here only if its rank is below `bar`
        bar = len(parts)
        while True:
            made = merged.get((left, right))
            if made is not None and made < bar:
                return False
            # undo the later of the two; of equal ones the right, since merges go from the left
            if left > right:
                bar, inner = left, parts[left][1]
                if inner == left:
                    return True
                left = inner
            else:
                bar, inner = right + 1, parts[right][0]
                if inner == right:
                    if left < 256:
                        return True
                    bar, left = left, parts[left][1]
                else:
                    right = inner

    def encode_piece(self, data: bytes) -> list[int]:
        """Ranks of the tokens of one piece."""
        length, shorter, fits = self.length, self.shorter, self.fits
        longest = [0] * len(data)
        for end, token in self.matcher.iter(data.decode("latin-1")):
            longest[end + 1 - length[token]] = token
        out, at, size = [], 0, len(data)
        dead = bytearray(size + 1)
        token = longest[0] if size else -1
        while at < size:
            before = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if not dead[end] and (before < 0 or fits(before, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < size else -1
            else:
                dead[at] = 1
                last = out.pop()
                at -= length[last]
                token = shorter[last]
        return out

    def piece(self, text: str) -> tuple[str, bytes]:
        """A piece's ids as decimals, each followed by a comma, and as 32-bit numbers."""
        ids = [self.id[r] for r in self.encode_piece(text.encode())]
        found = "".join(f"{i}," for i in ids), np.array(ids, "<i4").tobytes()
        if len(text) <= 64:
            if len(self.known) >= PIECE_MEMORY:
                self.known.clear()
            self.known[text] = found
        return found

    def encode(self, text: str) -> tuple[str, np.ndarray]:
        """The ids of a text as decimals joined by commas, and as an array. Special tokens in the text are found."""
        known, piece = self.known, self.piece
        found = []
        for part in self._cut(text):
            if part in self.special and found is not None:
                i = self.special[part]
                found.append((f"{i},", np.array([i], "<i4").tobytes()))
            else:
                for x in SPLIT.findall(part):
                    found.append(known.get(x) or piece(x))
        return "".join([x[0] for x in found])[:-1], np.frombuffer(b"".join([x[1] for x in found]), "<i4")

    def _cut(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            return [text]
        return [x for x in regex.split("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")", text) if x]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, gathered from the offset table in one step."""
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)].tobytes()


SPLIT = regex.compile(PIECES)
_LOADED: dict[str, Vocabulary] = {}


def load(text: str) -> Vocabulary:
    """The vocabulary of this JSON text, built once for each worker process."""
    name = hashlib.sha256(text.encode()).hexdigest()
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = Vocabulary(text)
    return _LOADED[name]


def encode(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text", carry: list[str] = (), with_ids: bool = False) -> DataFrame:
    """One row for each row of docs: id, the columns in `carry`, n_tokens, ids_sha256, decoded_sha256 and, if asked,
    token_ids (array<int>).

    `vocabulary` is the text of a tokenizers JSON file, a few MB, which is broadcast. Null texts count as empty:
    no tokens. Decoding goes back from the ids; bytes that are no UTF-8 would be replaced, which never happens
    for the ids of a text. Repeated rows get equal results; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.struct(quoted(id).alias("id"), *(quoted(c) for c in carry)).alias("row"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    kind = T.StructType([rows.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
                         *[T.StructField("token_ids", T.ArrayType(T.IntegerType()))] * with_ids])

    def run(batches):
        voc = load(shared.value)
        for batch in batches:
            for b in text_slices(batch):
                n, marks, decoded, lists = [], [], [], []
                for t in b.column("text"):
                    decimals, ids = voc.encode(t.as_py())
                    n.append(len(ids))
                    marks.append(hashlib.sha256(decimals.encode()).hexdigest())
                    back = voc.decode(ids).decode("utf-8", "replace")
                    decoded.append(hashlib.sha256(back.encode()).hexdigest())
                    if with_ids:
                        lists.append(ids)
                out = [b.column("row"), pa.array(n, pa.int64()), pa.array(marks, pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    ends = np.append(0, np.cumsum(n)).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists), pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=["row", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"][:len(out)])
        release_memory()

    got = rows.mapInArrow(run, kind)
    return got.select(F.col("row.id").alias(id), *(F.col("row")[c].alias(c) for c in carry), *got.columns[1:])
