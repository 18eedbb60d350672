import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from runloom.llm.common import table
from runloom.llm.mixing import apportion, mix, mix_documents, quotas, source_targets
from runloom.llm.sharding import greedy_cuts, minimax_capacity, shard_documents


@pytest.mark.parametrize("sizes", [[5], [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5], [100, 1, 1, 1, 1], [7] * 24])
def test_minimax_is_least(spark, sizes):
    def need(c):
        n, fill = 1, 0
        for s in sizes:
            if fill + s > c:
                n, fill = n + 1, 0
            fill += s
        return n

    want = next(c for c in range(max(sizes), sum(sizes) + 1) if need(c) <= 4)
    row = spark.createDataFrame([(sizes,)], "s array<long>").select("s", minimax_capacity(F.col("s"), 4).alias("c"))
    r = row.select("c", greedy_cuts(F.col("s"), F.col("c")).alias("cuts")).first()
    assert r.c == want and len(r.cuts) == need(want) - 1


def test_shards(spark, docs, no_docs, sample):
    for d in (docs, table(spark, sample, "documents")):
        rows = shard_documents(d).collect()
        text = d.select("doc_id", "text").collect()
        assert len(rows) == len(text)
        assert sorted(r.size for r in rows) == sorted(len((t.text or "").encode()) + 1 for t in text)
        assert sorted(r.text_crc32 for r in rows) == sorted(zlib.crc32((t.text or "").encode()) for t in text)
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
        by_crc = defaultdict(set)
        for r in rows:
            if r.size > 1:
                by_crc[r.text_crc32].add(r.shard)
        assert all(len(s) == 1 for s in by_crc.values())
    assert shard_documents(no_docs).count() == 0


def test_shard_sizes_are_near_equal(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    sizes = [r.s for r in shard_documents(d).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) <= sum(sizes) / 8 * 1.02


def plain_sainte_lague(targets, seats):
    n = [0] * len(targets)
    for _ in range(seats):
        i = max(range(len(targets)), key=lambda k: (targets[k] / (2 * n[k] + 1), -k))
        n[i] += 1
    return n


@pytest.mark.parametrize("targets,seats", [([50.0, 30.0, 20.0], 10), ([1.0, 1.0, 1.0], 4), ([0.0, 5.0], 3), ([340.5, 120.25, 99.0, 1.5], 101), ([3.0], 0)])
def test_apportionment(spark, targets, seats):
    row = spark.createDataFrame([(targets, seats)], "t array<double>, n long").select(apportion(F.col("t"), F.col("n")).alias("g")).first()
    got = [x.seats for x in sorted(row.g, key=lambda x: x.i)]
    assert got == plain_sainte_lague(targets, seats)


def plain_targets(sizes, share=1.5, cap=2.0):
    w = [[5, 2, 1][i % 3] for i in range(len(sizes))]
    left, t, fixed = share * sum(sizes), [0.0] * len(sizes), set()
    while True:
        live = [i for i in range(len(sizes)) if i not in fixed]
        if not live:
            return t
        rest = left - sum(cap * sizes[i] for i in fixed)
        total = sum(w[i] for i in live)
        for i in live:
            t[i] = rest * w[i] / total
        over = [i for i in live if t[i] > cap * sizes[i]]
        if not over:
            return t
        for i in over:
            t[i] = cap * sizes[i]
            fixed.add(i)


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 5, 70, 0, 3], [1], [0, 0], [500, 1, 1, 1, 1, 1, 900]])
def test_targets_are_those_of_resharing(spark, sizes):
    rows = spark.createDataFrame([(f"s{i:02d}", f"{i:02d}", s) for i, s in enumerate(sizes)], "skey string, source string, source_size long")
    got = [r.target for r in sorted(source_targets(rows).collect(), key=lambda r: r.rank)]
    assert got == pytest.approx(plain_targets(sizes))


def test_mix(spark, docs, no_docs, sample):
    assert mix(no_docs).count() == 0
    for d in (docs, table(spark, sample, "documents"), table(spark, "/root/testdata/sf0.01", "documents")):
        rows = mix(d).collect()
        assert len(rows) == d.count()
        taken, target, size = defaultdict(int), {}, defaultdict(int)
        for r in rows:
            assert 0 <= r.taken <= 2 * r.size
            taken[r.source] += r.taken
            target[r.source] = r.target
            size[r.source] += r.size
        assert all(r.source_size == size[r.source] for r in rows)
        for s in target:
            assert abs(taken[s] - target[s]) <= 0.01 * target[s] + 2
        again = {(r.doc_id, r.taken) for r in mix(d).collect()}
        assert again == {(r.doc_id, r.taken) for r in rows}


def test_shard_quotas_sum_up(spark):
    rows = spark.createDataFrame([("sa", "a", 900), ("sb", "b", 400), ("n", None, 77)], "skey string, source string, source_size long")
    for r in quotas(source_targets(rows), 1, n_shards=5).collect():
        assert len(r.until) == 5 and r.until[-1] == r.seats and r.until == sorted(r.until)


def test_each_shard_takes_its_quota(spark):
    """Against the quotas by highest quotients: shard by shard, each word of the row in its turn."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(37 + 211 * i % 1500)), f"s{i % 3}") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = [sum(len(t.split()) for _, t, s in rows if s == f"s{k}") for k in range(3)]
    target = plain_targets(sizes)
    house = round(1.5 * sum(sizes))
    got = defaultdict(int)
    for r in mix(d, n_shards=4).collect():
        turns = defaultdict(list)
        for p in r.pieces:
            got[r.source, p.shard] += p.end - p.first
            turns[p.turn].append((p.first, p.end))
        for t in turns.values():  # no word twice in a turn
            t.sort()
            assert all(a[1] <= b[0] for a, b in zip(t, t[1:])) and t[-1][1] <= r.size
    before = [0, 0, 0]
    for k in range(4):
        now = plain_sainte_lague(target, house * (k + 1) // 4)
        now = [min(x, 2 * s) for x, s in zip(now, sizes)]
        assert [got[f"s{i}", k] for i in range(3)] == [a - b for a, b in zip(now, before)]
        before = now


def test_mixed_documents_hold_the_words_taken(spark, docs):
    d = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    want = {r.doc_id: r.taken for r in mix(d).collect() if r.taken}
    got = defaultdict(int)
    texts = {r.doc_id: r.text for r in d.collect()}
    out = mix_documents(d)
    assert out.columns == d.columns
    for r in out.collect():
        got[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text) and r.text in texts[r.doc_id]
    assert got == want


def test_white_space_within_a_run_stays(spark):
    rows = [(i, "\n\n".join(f"a{i}b{j}\t c{j}" for j in range(900)) + " \n", "s") for i in range(5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts = {r[0]: r[1] for r in rows}
    out = mix_documents(d).collect()
    assert any(r.text != texts[r.doc_id] for r in out) and all(r.text in texts[r.doc_id] for r in out)


def test_a_tiny_source_leaves_the_others_whole(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(300)), "en", f"s{i % 4}", 0) for i in range(80)]
    rows.append((100, " ".join(f"n{j}" for j in range(60)), "en", None, 0))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken, target = defaultdict(int), {}
    for r in mix(d).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    # Texts are only cut where a block of a thousand words ends or the quota does.
    texts = {r[0]: r[1] for r in rows}
    out = mix_documents(d).collect()
    assert all(r.text in texts[r.doc_id] for r in out)
    assert sum(r.text != texts[r.doc_id] for r in out) <= 2 * sum(300 * 20 // 1024 + 2 for _ in range(5))
    assert len(out) <= 2 * len(rows)
