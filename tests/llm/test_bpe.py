import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quaymark.llm import bpe

CODEC = bpe.Codec(bpe.vocabulary())
LIB = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))

HARD = [
    "", " ", "\n\t", "Hello World's  it's 123\n\t été ###$$$ ǅ", "<|endoftext|> a<|startoftext|>b<|endoftext", "naïve 　x y\u0085z", "\x00a​b\x1c\x1dc",
    "don't DON'T ’s 'S''t 'rex", "ΑΣ ΣΑΣ İstanbul ﬁ ǅ", "é ́x á̧", "a" * 5000, "ab" * 3000 + "'ll", "9" * 300, "日本語テキスト 한국어 😀😀", "!" * 999, "１２３ ⅷ ² x²",
]


@pytest.mark.parametrize("text", HARD)
def test_same_as_library(text):
    ids = LIB.encode(text, add_special_tokens=False).ids
    got = CODEC.encode(text)
    assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == ids
    assert CODEC.decode(got) == LIB.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60) | st.text("abcdeinothrs' ", max_size=80))
def test_same_as_library_any(text):
    got = CODEC.encode(text)
    assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == LIB.encode(text, add_special_tokens=False).ids


def test_query_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = LIB.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_repeats_and_clashes(spark):
    docs = spark.createDataFrame([(1, None, 7, "x"), (None, "a b", 8, "y"), (2, "a b", 9, "z"), (2, "a b", 9, "z")], "doc_id bigint, text string, n_tokens int, ids string")
    rows = bpe.digests(docs).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 2, 2, 2]
    assert bpe.digests(docs.limit(0)).count() == 0
    named = bpe.decode(bpe.encode(spark.createDataFrame([(5, "a b")], "ids bigint, text string"), id_col="ids"), id_col="ids")
    assert named.columns == ["ids", "n_tokens", "ids_", "decoded"] and named.first()[0] == 5


def test_long_text(spark):
    text = "Ein longer text, with 12 numbers; and wordsthatrunonandon " * 20_000
    got = bpe.digests(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    ids = LIB.encode(text, add_special_tokens=False).ids
    assert got.n_tokens == len(ids) and got.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()


def test_batches_of_many_bytes():
    import pyarrow as pa

    from quaymark.llm import common

    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(["x" * 400_000 if k % 3 else None for k in range(300)])], names=["id", "text"])
    parts = list(common.sliced(iter([batch])))
    assert len(parts) > 2 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(sum(len(t or "") for t in p.column(1).to_pylist()) <= common.SLICE_BYTES for p in parts)
    assert [p.num_rows for p in common.sliced(iter([batch.select(["id"])]))] == [256, 44]
