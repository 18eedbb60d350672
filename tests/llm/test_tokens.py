import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from runloom.llm import records as R
from runloom.llm.common import scratch, table, tokenizer_path
from runloom.llm.packing import cuts, hilbert, pack
from runloom.llm.tokens import Encoder
from tokenizers import Tokenizer

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cached_ids_equal_the_tokenizers(path):
    r = random.Random(3)
    some = "ab C'sdé  \n\n\t\r\x0b\x0c\x1c\x85\xa0" + chr(0x2003) + chr(0x3000) + "0Σ9.,!|İßΑ中é" + chr(0x301)
    texts = ["".join(r.choice(some) for _ in range(r.randint(0, 50))) for _ in range(4000)] + ["", " ", "a ", " a", "a  b", "a\n b", "I'm it's", "x<|endoftext|>y", "z" * 5000]
    t = Tokenizer.from_file(path)
    got = Encoder(path).ids(texts)
    for text, g in zip(texts, got):
        assert np.frombuffer(g, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def plain(d, path, end):
    t = Tokenizer.from_file(path)
    return [(r.doc_id, np.array([*t.encode(r.text or "", add_special_tokens=False).ids, end], dtype="<u4")) for r in d.select("doc_id", "text").collect()]


def test_records_round_trip(spark, docs, no_docs, sample):
    assert R.token_records(no_docs, BYTE).count() == 0
    for d in (docs, table(spark, sample, "documents")):
        rows = sorted(R.token_records(d, BYTE).collect(), key=lambda r: r.start)
        want = plain(d, BYTE, 0)
        assert [r.doc_id for r in rows] == sorted((i for i, _ in want), key=lambda i: (i is not None, i or 0))
        assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in rows) == sorted((i or -1, len(x), zlib.crc32(x.tobytes())) for i, x in want)
        at = 0
        for r in rows:
            assert r.start == at
            at += r.n_tokens


def test_damage_is_found():
    data = bytearray(R.frame(R.payload(7, b"\1\0\2\0", 2)) + R.frame(R.payload(None, b"", 2)))
    bodies = list(R.read_frames(memoryview(bytes(data))))
    assert R.unpacked(bodies[0])[0] == 7 and R.unpacked(bodies[0])[1].tolist() == [1, 2] and R.unpacked(bodies[1])[0] is None
    for at in (0, 9, 15, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(R.read_frames(memoryview(bytes(bad))))


def test_records_in_any_order(spark, docs):
    path = scratch(spark, "shuffled")
    files = R.write_records(docs, path, BYTE, partitions=3).collect()
    store, top = R._open(path)
    for f in files:
        offsets = np.frombuffer(store.open_input_file(f"{top}/{f.file}.idx").read(), dtype="<u8")
        assert len(offsets) == f.n
        data = memoryview(store.open_input_file(f"{top}/{f.file}.rec").read())
        there = [bytes(b) for b in R.read_frames(data)]
        assert [bytes(b) for b in R.read_frames(data, offsets[::-1])] == there[::-1]


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_visits_neighbours(dims, bits):
    from itertools import product

    pts = np.array(list(product(range(1 << bits), repeat=dims)))
    k = hilbert(pts, bits)
    assert sorted(k.tolist()) == list(range(len(pts)))
    assert (np.abs(np.diff(pts[np.argsort(k)], axis=0)).sum(axis=1) == 1).all()


def test_pack(spark, docs, no_docs, sample):
    assert pack(no_docs, WORD).count() == 0
    assert cuts(5000) == [2048, 2048, 512, 256, 128, 8] and sum(cuts(4095)) == 4095
    for d in (docs, table(spark, sample, "documents")):
        rows = pack(d, WORD).collect()
        seqs = {}
        for r in rows:
            seqs.setdefault(r.sequence_id, []).append(r)
            assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        for s in seqs.values():
            at = 0
            for r in sorted(s, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 2048 and at & (at - 1) == 0
        # Together the pieces are the documents' ids, each once.
        want = sorted((i or -1, k, int(x)) for i, ids in plain(d, WORD, 1) for k, x in enumerate(ids))
        got = sorted((r.doc_id or -1, r.start + k, int(x)) for r in rows for k, x in enumerate(np.frombuffer(r.ids, "<u4")))
        assert got == want
    assert F is not None
