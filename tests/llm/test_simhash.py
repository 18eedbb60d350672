import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from runloom.llm import simhash as S
from runloom.llm.common import table


def brute_fp(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    three = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in three]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    ids = list(range(len(rows)))
    up = ids[:]
    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, j in combinations(ids, 2):
        if bin(rows[i][1] ^ rows[j][1]).count("1") <= 3:
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    least = {}
    for i in ids:
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return [least.get(find(i)) for i in ids]


def test_matches_brute_force(spark, docs, sample):
    for d in (docs, table(spark, sample, "documents")):
        rows = [(r.doc_id, brute_fp(r.text)) for r in d.select("doc_id", "text").collect()]
        want = sorted(((i, f"{fp:016x}", c) for (i, fp), c in zip(rows, brute_components(rows))), key=repr)
        got = S.near_duplicates(d).select("doc_id", S.fingerprint_hex("fp").alias("h"), "component_id").collect()
        assert sorted(map(tuple, got), key=repr) == want


@pytest.mark.parametrize("hot", [2, 4096])
def test_clusters_of_near_fingerprints(spark, hot):
    """Chains of small steps, in a large group: the same links through small and divided buckets."""
    r = np.random.default_rng(5)
    fps, base = [], [int(x) for x in r.integers(0, 2**63, 30)]
    for b in base:
        for _ in range(12):
            b ^= sum(1 << int(k) for k in r.choice(64, r.integers(0, 4), replace=False))
            fps.append(b)
    fps += [int(x) for x in r.integers(0, 2**63, 200)]
    fps = list(dict.fromkeys(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    d = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in S.components(S.links(d, hot)).collect()}
    got = [roots.get(x, x) for x in signed]
    want = brute_components(list(zip(signed, fps)))
    same = lambda v: [v.index(x) for x in v]
    assert same(got) == same(want)


def test_buckets_stay_whole_beside_large_ones(spark):
    """Where buckets above ``hot`` are joined out, the rows of the others, read by many tasks, still meet."""
    r = np.random.default_rng(6)
    flip = lambda x, bits, n: int(x) ^ sum(1 << int(k) for k in r.choice(bits, n, replace=False))
    group = {flip(1 << 62, 63, int(n)) for n in r.integers(0, 4, 400)}
    pairs = [(int(x), flip(x, 63, 3)) for x in r.integers(0, 1 << 62, 1000)]
    d = spark.createDataFrame([(x,) for x in {*group, *(x for p in pairs for x in p)}], "fp long").repartition(16)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")  # as with large tables, whose partitions aren't put together
    try:
        found = {(x.a, x.b) for x in S.links(d, 32).collect()}
    finally:
        spark.conf.unset(name)
    assert {(max(p), min(p)) for p in pairs} <= found


def test_allocation_is_least_and_sound():
    costs = [[0, 5, 40, 400], [0, 90, 500, 900], [0, 6, 50, 300], [0, 1000, 2000, 3000]]
    t = S.allocate(costs)
    assert sum(t) == 3 - 4 + 1
    from itertools import product

    best = min(sum(c[k + 1] for c, k in zip(costs, ks)) for ks in product(range(-1, 3), repeat=4) if sum(ks) == 0)
    assert sum(c[k + 1] for c, k in zip(costs, t)) == best


def test_keep_one(spark, docs, no_docs):
    assert S.near_duplicates(no_docs).count() == 0 and S.keep_one(no_docs).count() == 0
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    # 1 stands for 2 and its copy; 3 for the other texts without words.
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 3, 6, 7, 8, 9]
    assert sum(r.doc_id is None for r in rows) == 1


def test_keep_one_goes_by_similarity(spark):
    """Pairs with known Jaccard similarity of five-word shingles, on both sides of 0.8."""
    r = np.random.default_rng(8)
    rows, want = [], set()
    for k in range(40):
        words = [f"t{k}w{x}" for x in r.integers(0, 10_000, 200)]
        changed = words[:]
        for at in (20, 60, 100, 140, 180)[: 1 + k % 5]:
            changed[at] = "other"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed))]
        sets = [{tuple(w[i : i + 5]) for i in range(196)} for w in (words, changed)]
        near = len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
        want |= {2 * k} if near else {2 * k, 2 * k + 1}
    assert 40 < len(want) < 80
    # A chain: each is near the next, the first and the last are not.
    chain = [f"c{x}" for x in range(300)]
    for j in range(4):
        chain[60 * j + 30 : 60 * j + 40] = [f"d{j}x{i}" for i in range(10)]
        rows.append((1000 + j, " ".join(chain)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in S.keep_one(d).collect()} == want | {1000}


def test_texts_go_by_their_whole_keys(spark):
    """Keys that agree in all but their last byte are different texts."""
    words = [[f"{c}{i}" for i in range(40)] for c in "abc"]
    rows = [(bytes(15) + bytes([k]), " ".join(w)) for k, w in enumerate(words)] + [(bytes(15) + bytes([9]), " ".join([*words[0][:39], "z"]))]
    got = {bytes(r["_key"]): r.root for r in S.copy_groups(spark.createDataFrame(rows * 2, "_key binary, text string")).collect()}
    assert len(got) == 4 and len(set(got.values())) == 3 and got[bytes(16)] == got[bytes(15) + bytes([9])]
