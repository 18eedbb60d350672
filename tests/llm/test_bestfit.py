"""Operator 12: its bins, its pieces, and how near it comes to the fewest sequences."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from runloom.llm import bestfit as B
from runloom.llm.common import tokenizer_path
from runloom.llm.queries import QUERIES


def fewest(sizes, length):
    """Exact, for a few items: the least number of bins, by trying all."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(order):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + order[i] <= length and bins[b] not in bins[:b]:
                place(i + 1, [*bins[:b], bins[b] + order[i], *bins[b + 1 :]])
        place(i + 1, [*bins, order[i]])

    order = sorted(sizes, reverse=True)
    place(0, [])
    return best


def holds(bins, sizes, length):
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in b) <= length for b in bins)


def test_against_all_packings():
    rng = random.Random(4)
    over = 0
    for _ in range(150):
        sizes = [rng.randint(1, rng.choice([20, 12, 7])) for _ in range(rng.randint(1, 11))]
        bins = B.packed(sizes, 20)
        holds(bins, sizes, 20)
        over += len(bins) - fewest(sizes, 20)
    assert over <= 3


def test_the_search_saves_bins():
    """Best fit alone puts 6 with 3, and needs three bins; an exchange frees one."""
    saved = 0
    rng = random.Random(8)
    for _ in range(300):
        sizes = [rng.choice([151, 201, 251, 301, 349, 401, 499, 523]) for _ in range(60)]
        first = B.best_fit(sizes, 1024)
        holds(first, sizes, 1024)
        then = B.improve([list(b) for b in first], sizes, 1024)
        holds(then, sizes, 1024)
        assert len(then) <= len(first)
        saved += len(first) - len(then)
    assert saved > 20


def test_each_step_raises_the_squares(monkeypatch):
    rng = random.Random(1)
    sizes = [rng.randint(200, 700) for _ in range(400)]
    bins = B.best_fit(sizes, 1024)
    squares = lambda bs: sum(sum(sizes[i] for i in b) ** 2 for b in bs)
    while True:
        after, stepped = B._round([list(b) for b in bins], sizes, 1024)
        holds(after, sizes, 1024)
        if not stepped:
            break
        assert squares(after) > squares(bins)
        bins = after


def test_large_groups_come_near_the_bound():
    rng = np.random.default_rng(3)
    sizes = np.minimum(1 + rng.lognormal(5, 1, 9000).astype(int), 1023).tolist()
    bins = B.packed(sizes)
    holds(bins, sizes, 1024)
    assert len(bins) <= 1.001 * -(-sum(sizes) // 1024)
    assert len(B.packed([1] * 5000)) == 5 and len(B.packed([600] * 500)) == 500


def test_pieces():
    assert B.pieces_of(5, 4) == [(0, 1), (1, 4)] and B.pieces_of(8, 4) == [(0, 4), (4, 4)] and B.pieces_of(3, 4) == [(0, 3)]


def check(got, texts, length):
    """texts: (doc_id, text) of all rows. Returns the number of sequences and tokens."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = sorted((i if i is not None else -1, tuple(tok.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t in texts)
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u2").astype("<u4")
        assert len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        docs[r["doc_id"]].append((r["piece"], r["start"], tuple(ids.tolist())))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= length
    for i in {i for i, _ in texts if [j for j, _ in texts].count(i) == 1}:
        whole = [ids for j, ids in want if j == (i if i is not None else -1)][0]
        pieces = sorted(docs[i])
        assert [p for p, _, _ in pieces] == list(range(len(pieces)))
        assert sum((ids for _, _, ids in pieces), ()) == whole
        at = 0
        for n, (_, start, ids) in enumerate(pieces):
            assert start == at and (len(pieces) == 1 or n == 0 or len(ids) == length)
            at += len(ids)
    total = sum(len(ids) for _, ids in want)
    assert sum(r["length"] for r in got) == total
    return len(seqs), total


def test_odd_documents(spark, docs):
    path = tokenizer_path("byte_bpe_50k.json")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(B.pack_best_fit(docs, path).collect(), texts, 1024)
    check(B.pack_best_fit(docs, path, length=64, group=256).collect(), texts, 64)


def test_no_documents(spark, no_docs):
    assert B.pack_best_fit(no_docs, tokenizer_path("byte_bpe_50k.json")).collect() == []


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_tables(spark, size):
    d = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    got = B.pack_best_fit(d, tokenizer_path("byte_bpe_50k.json"))
    n, total = check(got.collect(), [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()], 1024)
    assert n <= 1.003 * -(-total // 1024) + 1
    assert QUERIES["op12_best_fit"](spark, f"/root/testdata/{size}").count() == got.count()
