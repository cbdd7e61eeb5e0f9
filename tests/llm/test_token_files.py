import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import queries as Q
from tidemark.llm import token_files as T

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def brute_force(library, rows):
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 4096])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    for top in (1, 2, 50_000, 2**32 - 1):
        ids = rng.integers(0, top, n, endpoint=True).astype(np.uint32)
        assert (T.unpack_block(T.pack_block(ids)) == ids).all()


def test_file_round_trip_and_random_access():
    class Kept(io.BytesIO):
        def close(self):
            pass

    kept, rng = Kept(), np.random.default_rng(1)
    docs = [rng.integers(0, 49_407, n).astype(np.uint32) for n in (3, 0, 100, 1, 517, 64, 0)]
    writer = T.TokenFileWriter(kept, block_ids=64)
    for i, ids in enumerate(docs):
        writer.add(None if i == 2 else i, ids)
    writer.close()
    file, whole = T.TokenFile(kept), np.concatenate(docs)
    assert file.lengths.tolist() == list(map(len, docs)) and file.known.tolist() == [i != 2 for i in range(7)]
    assert len(file.chunks) == -(-len(whole) // 64)
    for first, end in ((0, len(whole)), (0, 0), (63, 65), (100, 500), (len(whole) - 1, len(whole))):
        assert (file.ids(first, end) == whole[first:end]).all()


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_frames_equal_the_library(request, library, name):
    frame = request.getfixturevalue(name)
    rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
    manifest = T.write_tokens(frame, PATH, 2, block_ids=1000, file_ids=20_000)
    found = sorted(((r[0], r[1], bytes(r[2])) for r in T.read_tokens(manifest, stretch_docs=7).collect()), key=repr)
    assert found == brute_force(library, rows)


def test_query(spark, library, documents):
    rows = brute_force(library, [tuple(r) for r in documents.select("doc_id", "text").collect()])
    wanted = sorted((d, s, len(x) // 4, zlib.crc32(x)) for d, s, x in rows)
    assert sorted(map(tuple, Q.op5_token_files(spark, "/root/testdata/sf0.001").collect())) == wanted


def test_nothing(nothing):
    assert T.read_tokens(T.write_tokens(nothing, PATH, 2)).count() == 0
