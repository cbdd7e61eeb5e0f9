import gc

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe as B

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(B.read_ranks(PATH)), special_tokens={})


def ids_of(texts):
    ends, ids = B.BlockEncoder(PATH, public_tokenizers.PATTERN).encode(texts)
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aaabcdeé  \n\t'stld012"))), max_size=5))
def test_blocks_equal_the_library(library, texts):
    assert ids_of(texts) == [library.encode_ordinary(t) for t in texts]


def test_long_runs_equal_the_library(library):
    texts = ["a" * 5000, "ab" * 3000, " " * 4000, "\n" * 999, "Donaudampfschifffahrtsgesellschaft" * 50, "0" * 2001, "é" * 1500]
    assert ids_of(texts) == [library.encode_ordinary(t) for t in texts]


def test_frames_equal_the_library_and_decode(library, documents, odd):
    for frame in (documents, odd):
        encoded = B.encode(frame, PATH, public_tokenizers.PATTERN, block_chars=20_000)
        rows = B.decode(encoded, PATH).select("text", "ids", "decoded").collect()
        assert len(rows) == frame.count()
        for r in rows:
            assert r["ids"] == library.encode_ordinary(r["text"] or "")
            assert bytes(r["decoded"]).decode() == (r["text"] or "")
        again = B.round_trip(frame, PATH, public_tokenizers.PATTERN, block_chars=20_000)
        assert again.columns == B.decode(encoded, PATH).columns
        assert sorted(map(repr, again.select("text", "ids", "decoded").collect())) == sorted(map(repr, rows))


def test_nothing(nothing):
    out = B.decode(B.encode(nothing, PATH, public_tokenizers.PATTERN), PATH)
    assert out.count() == 0 and dict(out.dtypes)["ids"] == "array<int>" and "extra" in out.columns


def test_null_ids_decode_to_nothing(spark):
    rows = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [bytes(r[0]) for r in B.decode(rows, PATH).select("decoded").collect()] == [b"", b""]


def test_what_is_forgotten_is_learnt_again(library):
    encoder = B.BlockEncoder(PATH, public_tokenizers.PATTERN, known_bytes=4000)
    for turn in range(6):
        texts = [f"worde{turn}x{i} again{i % 7}, zzqx{i % 3}  {i}" for i in range(40)]
        ends, ids = encoder.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [library.encode_ordinary(t) for t in texts]
    assert encoder.spaced.size < 40_000 and encoder.pieces.size < 80_000


def test_nothing_is_remembered_after_a_task():
    """Workers outlive their tasks, so what one remembers would lie beside the work of later stages."""
    batch = pa.RecordBatch.from_pydict({"text": [f"left{i} over {i}" for i in range(50)]})
    encoded = list(B._encoded(iter([batch]), PATH, public_tokenizers.PATTERN, "text", 1000))
    assert sum(b.num_rows for b in encoded) == 50
    gc.collect()
    assert not [x for x in gc.get_objects() if isinstance(x, (B.BlockEncoder, B.Known, B.PairRanks))]


def test_odd_ids(spark, monkeypatch):
    monkeypatch.setattr(B, "DECODE_BYTES", 7)
    table = B.token_bytes(PATH)
    rows = [(list(range(k, k + k % 5)),) for k in range(300, 400)] + [(None,), ([],)]
    out = B.decode(spark.createDataFrame(rows, "ids array<int>").coalesce(1), PATH).collect()
    assert [(r["ids"], bytes(r["decoded"])) for r in out] == [(x, b"".join(table[i] for i in x or ())) for (x,) in rows]
    for wrong in ([len(table)], [-1], [None]):
        with pytest.raises(Exception, match="outside the vocabulary"):
            B.decode(spark.createDataFrame([(wrong,)], "ids array<int>"), PATH).collect()


def test_query_digests(spark, library):
    import hashlib

    from tidemark.llm import queries as Q

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = Q.op4_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
