from __future__ import annotations

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from recallbase.llm import tokenfile

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def file_of(docs, level=3):
    out = io.BytesIO()
    w = tokenfile.Writer(out, level)
    for i, ids in docs:
        w.add(i, ids)
    w.close()
    return out


def some(n, seed=1):
    rng = np.random.default_rng(seed)
    return [(int(i), rng.integers(0, 50_000, int(rng.integers(0, 5_000))).astype(np.uint32)) for i in range(n)]


def test_reads_back_any_document_and_only_its_frames():
    docs = some(60)
    out = file_of(docs)
    order = list(range(60))
    random.Random(2).shuffle(order)
    for k in order:
        r = tokenfile.Reader(out)
        ids = r.read(k)
        assert (ids == docs[k][1]).all() and r.index["doc_id"][k] == k
        start, n = int(r.index["start"][k]), len(ids)
        need = 0 if n == 0 else (start + n - 1) // tokenfile.FRAME_IDS - start // tokenfile.FRAME_IDS + 1
        assert r.opened == need


def test_any_zstandard_reader_decompresses_it():
    docs = some(30)
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(file_of(docs).getvalue()), read_across_frames=True).read()
    assert plain == b"".join(ids.astype("<u4").tobytes() for _, ids in docs)


def test_damage_is_noticed():
    docs = some(40)
    out = file_of(docs)
    raw = bytearray(out.getvalue())
    reader = tokenfile.Reader(out)
    raw[int(reader.at[1]) + int(reader.table[1, 0]) // 2] ^= 0x55
    broken = tokenfile.Reader(io.BytesIO(bytes(raw)))
    assert (broken.read(0) == docs[0][1]).all()
    with pytest.raises((ValueError, zstandard.ZstdError)):
        broken.frame(1)
    with pytest.raises(ValueError):
        tokenfile.Reader(io.BytesIO(out.getvalue()[:-1]))


def test_files_without_ids_or_documents():
    assert len(tokenfile.Reader(file_of([])).index) == 0
    r = tokenfile.Reader(file_of([(None, np.zeros(0, np.uint32)), (5, np.zeros(0, np.uint32))]))
    assert r.index["known"].tolist() == [0, 1] and len(r.read(1)) == 0


def test_round_trip_of_odd_rows(spark, odd, odd_rows, empty):
    tool = Tokenizer.from_file(BYTE)
    got = tokenfile.tokenize_to_files(odd, BYTE, 2).collect()
    want = sorted((-99 if r[0] is None else r[0], len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())) for r in odd_rows for ids in [tool.encode(r[1] or "", add_special_tokens=False).ids])
    assert sorted((-99 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    in_order = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert in_order == sorted(in_order)
    assert tokenfile.tokenize_to_files(empty, BYTE, 2).count() == 0
