"""Keyed upserts into a folder of sorted Parquet files: merge on read, then compaction.

1. ``write_table`` lays a table out in files of a fixed number of rows, in the key's order. Ranks come from a
   range partitioning: a row's place in its partition, and the sizes of the partitions before.
2. ``stage`` decides about the latest change of each key and writes two tables beside the folder: deletion vectors
   (file, Parquet row_index) of the rows that go or change, and deltas (file, row_index or null, all columns) of
   the rows that come or change. Changes that leave a row as it is are in neither. No data file is touched.
3. ``merged`` is the table as a reader sees it at that point: rows that no vector names, and the deltas.
4. ``compact`` reads only files that have a vector or delta, writes their rows to as few files as hold
   them, evenly, lets each of these join its left neighbour where both fit one file, and then removes the files that
   it read. All others stay as they are.

What goes through one task or the driver is one row for each file or partition, of a few numbers and a path: ``op13`` has
1,500 starting files at most, whatever its input. Rows are dealt by ranges of keys throughout, a key's changes are reduced before
they are shuffled, and every written table is in the shared folder, so that a lost executor costs its tasks only. New files appear
when their job commits, and only then are the old ones removed.

Cases: rows without a key take no part, in the table and in the changes. Rows of the table that share a key are changed or deleted alike.
Changes of a key: the greatest order columns win, nulls least; among repeated ones, it doesn't matter which.
A key belongs to the last file that begins at or below it, or else to the first one. A table
without rows has no files and so no homes: changes to it have no effect. Null and NaN values equal
themselves. Further columns of the table are kept, and are null in inserted rows; further columns of the changes are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from .common import _hadoop, checkpoint, drop, scratch, shared_dir, shuffle_partitions

#: Columns of a file's place, beside those of the table. Names that begin with __u_ are taken: a table's columns may have all others.
PATH, INDEX = "__u_path", "__u_index"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, which stays."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p, fs = _hadoop(spark, path)
    fs.mkdirs(p)
    return path


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows dealt out by ranges and sorted, with their partition (_part) and place in it (_at); checkpointed, as ranges are sampled."""
    d = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    d = d.withColumn("__u_id", F.monotonically_increasing_id())
    return checkpoint(d.select(*df.columns, F.shiftright("__u_id", 33).cast("int").alias("__u_part"), (F.col("__u_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("__u_at")))


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with their rank from 0 over all rows."""
    d = placed(df, order)
    before = Window.orderBy("__u_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a partition.
    starts = d.groupBy("__u_part").agg(F.count(F.lit(1)).alias("__u_n")).select("__u_part", F.coalesce(F.sum("__u_n").over(before), F.lit(0)).alias("__u_start"))
    return d.join(F.broadcast(starts), "__u_part").select(*df.columns, (F.col("__u_start") + F.col("__u_at")).alias("__u_rank"))


def write_files(rows: DataFrame, number: str, files: int, order: list[str], folder: str) -> None:
    """One file for each value of ``number``, which are 0 to files - 1 without gaps, each written by one task as its rows stream by."""
    if files:
        rows.repartitionById(files, F.col(number).cast("int")).sortWithinPartitions(*order).drop(number, *order).write.mode("append").parquet(folder)


def read_files(spark: SparkSession, schema: StructType, folder: str, paths: list[str] | None = None) -> DataFrame:
    """The rows of the folder (or of some of its files) with their file and row_index."""
    if paths is not None and not paths or paths is None and _is_empty(spark, folder):
        return spark.createDataFrame([], schema).select("*", F.lit("").alias(PATH), F.lit(0).cast("long").alias(INDEX))
    d = spark.read.schema(schema).parquet(*([folder] if paths is None else paths))
    return d.select(*schema.names, F.col("_metadata.file_path").alias(PATH), F.col("_metadata.row_index").alias(INDEX))


def _is_empty(spark: SparkSession, folder: str) -> bool:
    p, fs = _hadoop(spark, folder)
    return not any(f.getPath().getName().endswith(".parquet") for f in fs.listStatus(p))


def write_table(rows: DataFrame, key: str, folder: str, most: int) -> None:
    """Lay the rows out in files of ``most`` rows (the last: the rest), by key."""
    order = [F.col(key), F.xxhash64(*[c for c in rows.columns if c != key])] if len(rows.columns) > 1 else [F.col(key)]
    r = ranked(rows.filter(F.col(key).isNotNull()), order).withColumn("__u_file", F.floor(F.col("__u_rank") / most))
    files = r.agg(F.max("__u_file")).first()[0]
    write_files(r, "__u_file", 0 if files is None else files + 1, ["__u_rank"], folder)


def files_of(rows: DataFrame, key: str) -> DataFrame:
    """One row a file, in the key's order: its path, number (from 0), first key and rows."""
    f = rows.groupBy(PATH).agg(F.min(key).alias("__u_first"), F.max(key).alias("__u_last"), F.count(F.lit(1)).alias("__u_n"))
    return f.select(PATH, "__u_first", "__u_n", (F.row_number().over(Window.orderBy("__u_first", "__u_last", PATH)) - 1).alias("__u_file"))


def latest(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The change of each key that has the greatest ``order``; reduced before it is shuffled, so that no key is hot."""
    rest = [c for c in changes.columns if c != key and c not in order]
    d = changes.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("__u_w"))
    return d.select(key, "__u_w.*")


def with_home(changes: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Changes with the file (_file) that their key belongs to: the last one that begins at or below it, or else the first."""
    marks = files.select(F.col("__u_first").alias(key), F.col("__u_file").alias("__u_mark"), *[F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in changes.columns if c != key])
    d = placed(changes.withColumn("__u_mark", F.lit(None).cast("int")).unionByName(marks), [F.col(key), F.col("__u_mark").asc_nulls_last()])
    # Files are numbered in the key's order, so that the last one is the greatest number so far.
    last = d.groupBy("__u_part").agg(F.max("__u_mark").alias("__u_last"))
    carried = last.select("__u_part", F.max("__u_last").over(Window.orderBy("__u_part").rowsBetween(Window.unboundedPreceding, -1)).alias("__u_carried"))
    here = F.max("__u_mark").over(Window.partitionBy("__u_part").orderBy("__u_at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("__u_here", here).filter("__u_mark is null").join(F.broadcast(carried), "__u_part")
    return d.select(*changes.columns, F.coalesce("__u_here", "__u_carried", F.lit(0)).alias("__u_file"))


def stage(base: DataFrame, files: DataFrame, changes: DataFrame, key: str, sets: list[str], decide: Callable[[Column], tuple[Column, Column]], staging: str) -> tuple[DataFrame, DataFrame]:
    """Write deletion vectors and deltas. ``decide``: the first key of a change's home -> whether it counts, and whether it deletes."""
    spark, columns = base.sparkSession, [c for c in base.columns if c not in (PATH, INDEX)]
    c = with_home(changes, files, key).join(files.select("__u_file", F.col("__u_first").alias("__u_home_first"), F.col(PATH).alias("__u_home")), "__u_file").drop("__u_file")
    counts, deletes = decide(F.col("__u_home_first"))
    c = c.select(key, "__u_home", F.coalesce(deletes, F.lit(False)).alias("__u_deletes"), F.struct(*sets).alias("__u_new")).filter(counts)
    old = base.select(key, PATH, INDEX, F.struct(*[x for x in columns if x != key]).alias("__u_old"))
    c = c.hint("merge").join(old.hint("merge"), key, "left")
    found = F.col(INDEX).isNotNull()
    differs = ~F.struct(*[F.col(f"__u_old.{x}") for x in sets]).eqNullSafe(F.struct(*[F.col(f"__u_new.{x}").cast(base.schema[x].dataType).alias(x) for x in sets]))
    gone, changed, added = found & F.col("__u_deletes"), found & ~F.col("__u_deletes") & differs, ~found & ~F.col("__u_deletes")
    value = lambda x: F.col(key) if x == key else F.col(f"__u_new.{x}").cast(base.schema[x].dataType) if x in sets else F.col(f"__u_old.{x}")
    c.filter(gone | changed | added).select(
        *[value(x).alias(x) for x in columns], F.coalesce(PATH, "__u_home").alias(PATH), F.col(INDEX), gone.alias("__u_gone")
    ).write.parquet(f"{staging}/effects")  # settled once, then parted in two
    effects = spark.read.parquet(f"{staging}/effects")
    effects.filter(F.col(INDEX).isNotNull()).select(PATH, INDEX).write.parquet(f"{staging}/vectors")
    effects.filter(~F.col("__u_gone")).drop("__u_gone").write.parquet(f"{staging}/deltas")
    return spark.read.parquet(f"{staging}/vectors"), spark.read.schema(base.schema).parquet(f"{staging}/deltas")


def merged(base: DataFrame, vectors: DataFrame, deltas: DataFrame) -> DataFrame:
    """Merge on read: the rows that no vector names, and the deltas.

    Vectors are small as files, as paths repeat in them, but not in memory: they are never broadcast.
    """
    return base.join(vectors.hint("merge"), [PATH, INDEX], "left_anti").select(*base.columns).unionByName(deltas)


def cut_and_join(files: DataFrame, most: int) -> DataFrame:
    """Files with their rows to be (_rows) and whether they are rewritten (_marked) -> a row for each piece of each rewritten file:
    _file, _piece, _chain and _group: pieces of one chain and group share a new file.

    A file that isn't rewritten ends a chain, so chains are folded apart from each other.
    """
    up_to = Window.orderBy("__u_file").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    f = files.withColumn("__u_chain", F.sum(F.when(F.col("__u_marked"), 0).otherwise(1)).over(up_to)).filter("__u_marked and __u_rows > 0")
    n = F.ceil(F.col("__u_rows") / most)
    p = f.withColumn("__u_pieces", n).select("__u_file", "__u_chain", "__u_rows", "__u_pieces", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__u_pieces") - 1)).alias("__u_piece"))
    p = p.withColumn("__u_size", F.floor(F.col("__u_rows") / F.col("__u_pieces")) + F.when(F.col("__u_piece") < F.col("__u_rows") % F.col("__u_pieces"), 1).otherwise(0))

    def fold(rows):
        rows = rows.sort_values(["__u_file", "__u_piece"])
        group, total, out = -1, most, []
        for size in rows["__u_size"].tolist():
            if group >= 0 and total + size <= most:
                total += size
            else:
                group, total = group + 1, size
            out.append(group)
        return rows.assign(__u_group=out)[["__u_file", "__u_piece", "__u_chain", "__u_group"]]

    return p.groupBy("__u_chain").applyInPandas(fold, "__u_file int, __u_piece long, __u_chain long, __u_group int")


def compact(spark: SparkSession, schema: StructType, folder: str, files: DataFrame, vectors: DataFrame, deltas: DataFrame, key: str, most: int) -> None:
    """Rewrite the files that have a vector or delta, and no others."""
    less = vectors.groupBy(PATH).agg(F.count(F.lit(1)).alias("__u_less"))
    more = deltas.groupBy(PATH).agg(F.count(F.lit(1)).alias("__u_more"))
    f = files.join(less, PATH, "left").join(more, PATH, "left")
    marked = F.col("__u_less").isNotNull() | F.col("__u_more").isNotNull()
    f = checkpoint(f.select("__u_file", PATH, marked.alias("__u_marked"), (F.col("__u_n") - F.coalesce("__u_less", F.lit(0)) + F.coalesce("__u_more", F.lit(0))).alias("__u_rows")))
    old = [r[PATH] for r in f.filter("__u_marked").select(PATH).collect()]  # a path for each file
    if not old:
        return
    rows = merged(read_files(spark, schema, folder, old), vectors, deltas).join(f.select(PATH, "__u_file"), PATH)
    r = ranked(rows.select(*schema.names, "__u_file", INDEX), [F.col("__u_file"), F.col(key), F.col(INDEX).asc_nulls_last()])
    before = Window.orderBy("__u_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = f.filter("__u_marked").select("__u_file", "__u_rows", F.coalesce(F.sum("__u_rows").over(before), F.lit(0)).alias("__u_start"))
    pieces = F.ceil(F.col("__u_rows") / most)
    small, large = F.floor(F.col("__u_rows") / F.col("__u_pieces")), F.col("__u_rows") % F.col("__u_pieces")
    edge, at = F.col("__u_large") * (F.col("__u_small") + 1), F.col("__u_rank") - F.col("__u_start")
    r = r.join(starts, "__u_file").withColumn("__u_pieces", pieces).withColumn("__u_small", small).withColumn("__u_large", large)
    r = r.withColumn("__u_piece", F.when(at < edge, F.floor(at / (F.col("__u_small") + 1))).otherwise(F.col("__u_large") + F.floor((at - edge) / F.col("__u_small"))))
    target = (F.dense_rank().over(Window.orderBy("__u_chain", "__u_group")) - 1).alias("__u_target")
    targets = checkpoint(cut_and_join(f, most).select("__u_file", "__u_piece", target))
    n = targets.agg(F.max("__u_target")).first()[0]
    out = r.join(targets, ["__u_file", "__u_piece"]).select(*schema.names, "__u_rank", "__u_target")
    write_files(out, "__u_target", 0 if n is None else n + 1, ["__u_rank"], folder)
    for path in old:
        drop(spark, path)


def upsert(spark: SparkSession, schema: StructType, folder: str, changes: DataFrame, key: str, sets: list[str], order: list[str], decide: Callable[[Column], tuple[Column, Column]], most: int) -> DataFrame:
    """Bring a folder's table up to the changes; returns the paths of the files it had before."""
    staging = scratch(spark, "upsert")
    base = read_files(spark, schema, folder)
    files_of(base, key).write.parquet(f"{staging}/files")
    files = spark.read.parquet(f"{staging}/files")
    vectors, deltas = stage(base, files, latest(changes, key, order), key, sets, decide, staging)
    compact(spark, schema, folder, files, vectors, deltas, key, most)
    return files.select(PATH)


def digests(rows: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """A row for each file: path, first_id, n_rows, ids_sha256, and sums; a file's rows stream by in their order."""
    d = rows.select(PATH, INDEX, F.col(key).cast("long").alias("__u_key"), *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in sums.items()])
    d = d.repartition(shuffle_partitions(rows.sparkSession), PATH).sortWithinPartitions(PATH, INDEX)
    out = ["path", "first_id", "n_rows", "ids_sha256", *sums]
    n_sums = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, first, n, seen, total = None, 0, 0, hashlib.sha256(), [0] * n_sums
        row = lambda: [path, first, n, seen.hexdigest(), *total]
        for b in batches:
            done = []
            names = b.column(0).to_pylist()
            ids, values = b.column(2).to_pylist(), [b.column(3 + i).to_pylist() for i in range(n_sums)]
            for i, p in enumerate(names):
                if p != path:
                    if path is not None:
                        done.append(row())
                    path, first, n, seen, total = p, ids[i], 0, hashlib.sha256(), [0] * n_sums
                seen.update((f",{ids[i]}" if n else str(ids[i])).encode())
                n += 1
                for j, v in enumerate(values):
                    total[j] += v[i]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=out)
        if path is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in row()], names=out)

    return d.mapInArrow(run, ", ".join(f"{c} {'string' if c in ('path', 'ids_sha256') else 'long'}" for c in out))


def crc(c: Column) -> Column:
    return F.crc32(c.cast("string"))


def upsert_clients(clients: DataFrame, changes: DataFrame, folder: str) -> DataFrame:
    """The starting table, the upsert, and what the files then hold: see ``op13_upsert``."""
    spark, schema = clients.sparkSession, StructType([clients.schema[c] for c in clients.columns])
    most = 1 + clients.count() // 1500
    write_table(clients.filter(crc(F.col("client_id")) % 7 > 3), "client_id", folder, most)
    bucket = crc(F.col("__u_home_first")) % 10

    def decide(home: Column) -> tuple[Column, Column]:
        deletes = F.coalesce(F.col("op") == "D", F.lit(False)) | F.coalesce(crc(F.col("change_id")) % 8 < bucket, F.lit(False))
        return bucket <= 7, deletes

    sets = ["source", "segment", "city", "balance"]
    before = upsert(spark, schema, folder, changes.select("client_id", "change_id", "seq", "op", *sets), "client_id", sets, ["seq", "change_id"], decide, most)
    rows = read_files(spark, schema, folder)
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "segment", "city")])
    out = digests(rows, "client_id", {"cents": F.floor(100 * F.col("balance") + 0.5), "rows_crc": F.crc32(text)})
    old = before.select(F.col(PATH).alias("path"), F.lit(False).alias("rewritten"))
    return out.join(old, "path", "left").select(
        "first_id", "n_rows", "cents", "rows_crc", "ids_sha256", F.lit(",".join(rows.drop(PATH, INDEX).columns)).alias("columns"), "path", F.coalesce("rewritten", F.lit(True)).alias("rewritten")
    )
