"""Byte-pair encoding against the tokenizers library."""

import hashlib
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablestore.llm import bpe, queries
from tests.llm.test_operators import AWKWARD, KIND

PATH = queries.tokenizer_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(Path(PATH).read_text(encoding="utf-8"))


def same(library, vocabulary, text):
    want = library.encode(text, add_special_tokens=False).ids
    decimals, ids = vocabulary.encode(text)
    assert ids.tolist() == want and decimals == ",".join(map(str, want))
    assert vocabulary.decode(ids).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(library, vocabulary, text):
    same(library, vocabulary, text)


@settings(max_examples=200, deadline=None)
@given(st.text("aehtrinos'S \n", max_size=200))
def test_letters_that_merge_much(library, vocabulary, text):
    same(library, vocabulary, text)


@pytest.mark.parametrize("text", ["", " ", "a" * 20_000, "abab" * 5000, " " * 300, "x<|endoftext|>y", "<|endoftext|><|endoftext|> z", " <|endoftext|>\n\n", "a\x1c\x85\u2028\u200b\xa0 b"])
def test_special_and_long(library, vocabulary, text):
    same(library, vocabulary, text)


def test_all_code_points_of_the_basic_plane(library, vocabulary):
    for start in range(0, 0x10000, 512):
        same(library, vocabulary, " ".join(f"x{chr(c)}y{chr(c)}1" for c in range(start, start + 512) if not 0xD800 <= c < 0xE000))


def test_query(spark, sf, library):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in queries.op5_bpe(spark, sf).collect()} == want


def test_awkward_rows(spark, library):
    docs = spark.createDataFrame(AWKWARD, KIND).withColumns({c: F.lit("clash") for c in ("row", "id", "n_tokens")})
    got = bpe.encode(docs, Path(PATH).read_text(encoding="utf-8"), carry=["source"], with_ids=True).collect()
    assert sorted((str(r.doc_id), r.token_ids) for r in got) == sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in AWKWARD)
    assert bpe.encode(docs.where("false"), Path(PATH).read_text(encoding="utf-8")).count() == 0
