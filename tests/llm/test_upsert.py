"""Operator 13 against a plain model of its contract."""

import hashlib
import math
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from runloom.llm import upsert as U

SETS = ("source", "segment", "city", "balance")


def crc(x):
    return zlib.crc32(str(x).encode())


def model(clients, changes):
    """Lists of dicts -> {first_id: (ids, cents, rows_crc, rewritten)} in the files' order."""
    most = 1 + len(clients) // 1500
    start = sorted((c for c in clients if c["client_id"] is not None and crc(c["client_id"]) % 7 > 3), key=lambda c: c["client_id"])
    files = [start[i : i + most] for i in range(0, len(start), most)]
    if not files:
        return []
    firsts = [f[0]["client_id"] for f in files]
    low = lambda x: (x is not None, x if x is not None else 0)
    last = {}
    for c in changes:
        k = c["client_id"]
        if k is not None and (k not in last or (low(c["seq"]), low(c["change_id"])) > (low(last[k]["seq"]), low(last[k]["change_id"]))):
            last[k] = c
    tables = [{r["client_id"]: r for r in f} for f in files]
    for k, c in last.items():
        home = max((i for i, x in enumerate(firsts) if x <= k), default=0)
        h = crc(firsts[home]) % 10
        if h > 7:
            continue
        if c["op"] == "D" or crc(c["change_id"]) % 8 < h:
            tables[home].pop(k, None)
        else:
            row = dict(tables[home].get(k) or dict.fromkeys(clients[0], None), client_id=k)
            tables[home][k] = row | {s: c[s] for s in SETS}
    out = []  # [rows, rewritten]
    for f, t in zip(files, tables):
        rows = sorted(t.values(), key=lambda r: r["client_id"])
        if rows == f:
            out.append([rows, False])
            continue
        k = -(-len(rows) // most)
        at = 0
        for i in range(k):
            n = len(rows) // k + (i < len(rows) % k)
            out.append([rows[at : at + n], True])
            at += n
    joined = []
    for rows, new in out:
        if new and joined and joined[-1][1] and len(joined[-1][0]) + len(rows) <= most:
            joined[-1][0] += rows
        else:
            joined.append([list(rows), new])
    return joined


def described(rows, new):
    cents = sum(math.floor(100 * r["balance"] + 0.5) for r in rows if r["balance"] is not None)
    crcs = sum(zlib.crc32("|".join(r[c] or "" for c in ("source", "segment", "city")).encode()) for r in rows)
    ids = ",".join(str(r["client_id"]) for r in rows)
    return rows[0]["client_id"], len(rows), cents, crcs, hashlib.sha256(ids.encode()).hexdigest(), new


def check(spark, clients, changes):
    folder = U.new_folder(spark, "clients")
    got = U.upsert_clients(clients, changes, folder).orderBy("first_id").collect()
    want = [described(*x) for x in model([r.asDict() for r in clients.collect()], [r.asDict() for r in changes.collect()])]
    assert [(r["first_id"], r["n_rows"], r["cents"], r["rows_crc"], r["ids_sha256"], r["rewritten"]) for r in got] == want
    for r in got:
        t = pq.read_table(r["path"].removeprefix("file:"))
        assert t.column_names == clients.columns == r["columns"].split(",")
        ids = t.column("client_id").to_pylist()
        assert ids == sorted(ids) and ids[0] == r["first_id"] and len(ids) == r["n_rows"]
    p, fs = U._hadoop(spark, folder)
    assert len([f for f in fs.listStatus(p) if f.getPath().getName().endswith(".parquet")]) == len(got)
    return got


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_tables(spark, size):
    t = {n: spark.read.parquet(f"/root/testdata/{size}/{n}.parquet") for n in ("clients", "client_changes")}
    got = check(spark, t["clients"], t["client_changes"])
    assert {r["rewritten"] for r in got} == {True, False}


def small(spark, n, step=1):
    return spark.range(0, n * step, step).select(F.col("id").alias("client_id"), F.lit("a").alias("source"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("name"), F.lit(None).cast("string").alias("city"), F.lit("s").alias("segment"), (F.col("id") / 7).alias("balance"), F.lit(1).alias("_size"), *[F.col("id").alias(c) for c in ("_rank", "_path", "_file", "_index", "rank", "path", "n_rows", "op", "seq", "first_id")])


CHANGES = "client_id long, change_id long, seq long, op string, source string, segment string, city string, balance double, name string"


def test_larger_files_and_odd_changes(spark):
    clients = small(spark, 6000, 3)  # files of five rows
    rows = [(k, 10 * k, 1, "D" if k % 11 == 0 else "U", "b", None, "x" if k % 2 else None, None if k % 3 else 1.5, "not taken") for k in range(0, 18000, 2) if k % 7]
    rows += [(k, 10 * k, 0, "U", "older", None, None, 9.0, None) for k in range(0, 18000, 4)]
    rows += [(None, 1, 1, "U", "b", None, None, 1.0, None), (9, None, None, None, "b", None, None, 1.0, None), (-5, 3, 1, "U", "first", None, None, 1.0, None), (99_999, 3, 1, "U", "last", None, None, 1.0, None)]
    rows += rows[:50]
    check(spark, clients, spark.createDataFrame(rows, CHANGES))


def test_many_inserts_into_one_file_are_cut_evenly(spark):
    clients = small(spark, 3100)
    rows = [(100_000 + k, k, 1, "U", "b", "s", "c", 1.0, None) for k in range(400)]
    check(spark, clients, spark.createDataFrame(rows, CHANGES))


def test_no_changes_and_no_rows(spark):
    got = check(spark, small(spark, 50), spark.createDataFrame([], CHANGES))
    assert got and not any(r["rewritten"] for r in got)
    assert check(spark, small(spark, 0), spark.createDataFrame([(1, 1, 1, "U", "b", None, None, 1.0, None)], CHANGES)) == []


def test_merge_on_read_equals_the_compacted_table(spark):
    clients = small(spark, 300)
    folder, staging = U.new_folder(spark, "clients"), U.scratch(spark, "staging")
    U.write_table(clients, "client_id", folder, 40)
    base = U.read_files(spark, clients.schema, folder)
    files = U.checkpoint(U.files_of(base, "client_id"))
    changes = spark.createDataFrame([(k, k, 1, "D" if k % 2 else "U", "z", None, None, 0.5, None) for k in range(40, 90)] + [(1000, 1, 1, "U", "z", None, None, 0.5, None), (50, 1, 2, "U", "a", "s", None, 50 / 7, None)], CHANGES)
    decide = lambda home: (F.lit(True), F.col("op") == "D")
    last = U.latest(changes, "client_id", ["seq", "change_id"])
    vectors, deltas = U.stage(base, files, last, "client_id", list(SETS), decide, staging)
    seen = sorted(map(str, U.merged(base, vectors, deltas).drop(U.PATH, U.INDEX).collect()))
    # Row 50 is set to what it is, so nothing names it.
    assert vectors.count() == 49 and deltas.count() == 25
    U.compact(spark, clients.schema, folder, files, vectors, deltas, "client_id", 40)
    after = U.read_files(spark, clients.schema, folder)
    assert sorted(map(str, after.drop(U.PATH, U.INDEX).collect())) == seen
    same = {r[U.PATH] for r in after.select(U.PATH).distinct().collect()} & {r[U.PATH] for r in files.collect()}
    assert len(same) == 5  # of eight files, those of rows 40 to 119 and the last were written anew


def test_repeated_keys_change_alike(spark):
    rows = [(1, "a", 1.0), (1, "b", 2.0), (2, "c", 3.0), (None, "d", 4.0)]
    t = spark.createDataFrame(rows, "k long, s string, v double")
    folder = U.new_folder(spark, "t")
    U.write_table(t, "k", folder, 2)
    changes = spark.createDataFrame([(1, 5, "n")], "k long, o long, s string")
    U.upsert(spark, t.schema, folder, changes, "k", ["s"], ["o"], lambda home: (F.lit(True), F.lit(False)), 2)
    got = U.read_files(spark, t.schema, folder).select("k", "s", "v").orderBy("k", "v").collect()
    assert [tuple(r) for r in got] == [(1, "n", 1.0), (1, "n", 2.0), (2, "c", 3.0)]
