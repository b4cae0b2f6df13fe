"""The corpus pipeline against a plain version of its stages."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablestore.llm import mixing, queries
from tests.llm import brute
from tests.llm.test_operators import AWKWARD, KIND

WS = re.compile(r"[\x20\x09-\x0D]+")


def shingles(text, n):
    w = brute.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))}


def keep_good(rows):
    return [r for r, (_, kept) in zip(rows, brute.kept_by_rules(rows)) if kept]


def keep_one(rows):
    """Each text goes that is similar to one before, compared with all of them."""
    rank = lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())
    out, sets, texts = [], [], set()
    for r in sorted(rows, key=rank):
        mine = shingles(r[1], 5)
        if (r[1] or "") not in texts and all(len(mine & x) < 0.8 * len(mine | x) for x in sets):
            out.append(r)
            sets.append(mine)
            texts.add(r[1] or "")
    return out


def cut_windows(rows):
    texts = [brute.WORD.findall(t or "") for _, t, _ in rows]
    seen = Counter(tuple(w[k:k + 35]) for w in texts for k in range(len(w) - 34))
    out = []
    for (i, t, s), w in zip(rows, texts):
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k:k + 35])] > 1 for j in range(35)}
        if not gone:
            out.append((i, t, s))
        elif len(gone) < len(w):
            out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), s))
    return out


def mix(rows):
    taken = brute.mix([(k, t, s) for k, (_, t, s) in enumerate(rows)], mixing.WEIGHTS, mixing.MAX_EPOCHS, lambda k, t: brute.mix_key(mixing.SEED)(rows[k][0], t))
    out = []
    for k, size, _, _, n in taken:
        i, t, s = rows[k]
        out += [(i, t, s)] * (n // size if size else 0)
        rest = n % size if size else 0
        if rest:
            ends = [m.start() for m in brute.WORD.finditer(t)]
            out.append((i, t[:ends[rest]], s))
    return out


def encoded(rows, library):
    return sorted((str(i), s or "", tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t, s in rows)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_run(spark, sf, library):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = mix(cut_windows(keep_one(keep_good(rows))))
    # documents without words are never repeated by the plain version
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((str(r.doc_id), r.source or "", tuple(r.token_ids)) for r in got) == encoded(want, library)
    assert all(r.n_tokens == len(r.token_ids) for r in got)


def test_stages_keep_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "substring dedup", "source mixing", "bpe encoding"]


def test_stages_on_awkward_rows(spark, sf):
    docs = spark.createDataFrame(AWKWARD, KIND).withColumns({"lang": F.lit("xx"), "n_chars": F.length("text").cast("long"), "size": F.lit("clash"), "row": F.lit("clash"), "id": F.lit("clash")})
    plain = {
        "quality rules": keep_good(AWKWARD), "simhash near-dedup": keep_one(AWKWARD), "substring dedup": cut_windows(AWKWARD), "source mixing": mix(AWKWARD)}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name in plain:
            assert out.columns == docs.columns
            got = sorted((str(r.doc_id), r.text or "", str(r.source)) for r in out.collect() if (r.text or "").strip() or name != "source mixing")
            want = sorted((str(i), t or "", str(s)) for i, t, s in plain[name])
            assert [g[::2] for g in got] == [w[::2] for w in want]
            if name != "simhash near-dedup":
                assert got == want
        assert stage(spark, docs.where("false"), sf).count() == 0


def test_near_copies_go_and_clean_documents_stay(spark, sf):
    import random

    draw = random.Random(4)
    clean = [" ".join(f"{draw.choice('abcdefgh')}{draw.randrange(5000)}" for _ in range(300)) for _ in range(40)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(clean)]
    for i in range(10):
        w = clean[i].split()
        rows += [(100 + i, clean[i], "s0"), (200 + i, clean[i].upper(), "s1"), (300 + i, " ".join(w[:150] + ["changed"] + w[151:]), "s2")]
    docs = spark.createDataFrame(rows, KIND).withColumns({"lang": F.lit("xx"), "n_chars": F.length("text").cast("long")})
    kept = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, sf).collect()}
    assert kept == set(range(40))
    assert corpus_pipeline.quality_rules(spark, docs, sf).count() == len(rows)


def test_no_similar_documents_are_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id: shingles(r.text, 5) for r in corpus_pipeline.simhash_dedup(spark, docs, sf).collect()}
    similar = [(a, b) for a in kept for b in kept if a < b and len(kept[a] & kept[b]) >= 0.8 * len(kept[a] | kept[b])]
    assert similar == []


def test_every_light_edit_goes(spark, sf):
    import random

    draw = random.Random(6)
    rows = []
    for i in range(40):
        w = [f"{draw.choice('abcdefgh')}{draw.randrange(5000)}" for _ in range(150)]
        rows.append((i, " ".join(w), "s0"))
        for at in (40, 80, 120):
            w[at] = "changed"
        rows.append((100 + i, " ".join(w), "s1"))
    docs = spark.createDataFrame(rows, KIND).withColumns({"lang": F.lit("xx"), "n_chars": F.length("text").cast("long")})
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, sf).collect()) == list(range(40))
