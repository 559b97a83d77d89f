"""Vector stores as partitioned Parquet tables.

A store is the set of rows with one ``store_id``: ``chunks(store_id, doc_id,
chunk_no, chunk, embedding)`` partitioned by ``store_part``, the id behind a letter,
so that reading never takes an id for a number.  Writing a store replaces only its
own partition (dynamic partition overwrite); reading one prunes to its directory;
deleting one removes its partition directory.

An *index* (``write_index``) is a folder with three tables that change together:
``chunks`` and ``stores`` (counters and metadata per store and write), both
partitioned by ``write_id``, and ``commits``, to which every write adds one row, in one
file, as its last step.  Readers see only committed writes, so a write that stops
shows nothing, and a write that is run again under its version is left out.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import chunks as C
from scriptorium.operators import vectors as V

NOT_FOUND = "not found"


def build_chunks(docs: DataFrame, store: str = "store_id", key: str = "doc_id", text: str = "text",
                 size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP, dim: int = V.EMBED_DIM,
                 with_text: bool = True, splitter: str = "fixed") -> DataFrame:
    """V3: chunk every document of every store and embed the chunks, row by row.
    ``with_text=False`` keeps only keys and vectors (enough for search);
    ``splitter`` is ``fixed`` (windows) or ``recursive``."""
    given, keys = docs.select(F.col(store).alias("store_id"), key, text), ["store_id", key]
    if splitter == "recursive":
        ch = C.recursive_chunks(given, text, keys, size, overlap)
    elif splitter == "fixed":
        ch = C.fixed_chunks(given, text, keys=keys, size=size, overlap=overlap)
    else:
        raise ValueError(f"unknown splitter {splitter!r}")
    return V.hash_embed(ch, "chunk", [*keys, "chunk_no"] + (["chunk"] if with_text else []), dim=dim)


def store_stats(chunks: DataFrame, docs: DataFrame | None = None, store: str = "store_id",
                text: str = "text", metadata: dict[str, str] | None = None) -> DataFrame:
    """V7: per store num_chunks, total_chars (of the indexed documents),
    embedding model and metadata."""
    st = chunks.groupBy("store_id").agg(F.count("*").cast("bigint").alias("num_chunks"))
    if docs is not None:
        chars = docs.groupBy(F.col(store).alias("store_id")).agg(
            F.count("*").cast("bigint").alias("num_docs"),
            F.sum(F.length(text)).cast("bigint").alias("total_chars"))
        st = chars.join(st, "store_id", "left").fillna(0, ["num_chunks"])
    meta = F.create_map(*[x for k, v in (metadata or {}).items() for x in (F.lit(k), F.lit(v))])
    return st.withColumn("embedding_model", F.lit(V.EMBEDDING_MODEL)).withColumn(
        "metadata", meta.cast("map<string,string>"))


def list_stores(chunks: DataFrame) -> DataFrame:
    """V8: the store ids present."""
    return chunks.select("store_id").distinct()


def drop_store(chunks: DataFrame, store_id: str) -> DataFrame:
    """V9 on a DataFrame: the rows of every other store."""
    return chunks.filter(F.col("store_id") != F.lit(store_id))


def _placed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("store_part", F.concat(F.lit("s"), F.col("store_id").cast("string")))


def write_store(chunks: DataFrame, path: str) -> None:
    """Write (or replace) the stores present in ``chunks``; other stores
    at ``path`` are untouched (dynamic partition overwrite)."""
    _placed(chunks).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("store_part").parquet(path)


def append_store(chunks: DataFrame, path: str) -> None:
    """Add chunks to the stores they name; what is there stays."""
    _placed(chunks).write.mode("append").partitionBy("store_part").parquet(path)


def read_store(spark: SparkSession, path: str, store_id: str | None = None) -> DataFrame:
    """Read the store table; a store id filter prunes to one partition."""
    df = spark.read.parquet(path)
    return (df if store_id is None else df.where(F.col("store_part") == F.lit(f"s{store_id}"))).drop("store_part")


def _folder(spark: SparkSession, path: str):
    """(file system, Hadoop path) of ``path``, wherever it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete_store(spark: SparkSession, path: str, store_id: str) -> bool:
    """V9: remove one store's partition directory; True if it existed.  Spark names
    the directory from the escaped id, so an id is never a path."""
    name = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(f"s{store_id}")
    fs, at = _folder(spark, os.path.join(path, f"store_part={name}"))
    return bool(fs.exists(at) and fs.delete(at, True))


# ------------------------------------------------------------------- index

COMMIT = "write_id string, seq bigint, version string"
COUNTS = "store_id string, num_docs bigint, total_chars bigint, num_chunks bigint, embedding_model string, metadata map<string,string>, replaces boolean, deleted boolean"


def _commits(spark: SparkSession, path: str) -> DataFrame:
    """Committed writes of an index; none where nothing was written yet."""
    fs, at = _folder(spark, os.path.join(path, "commits"))
    return spark.read.schema(COMMIT).parquet(os.path.join(path, "commits")) if fs.exists(at) else spark.createDataFrame([], COMMIT)


def _commit(spark: SparkSession, path: str, write_id: str, stores: DataFrame, version: str | None) -> None:
    """Adds the store rows of a write, then makes the whole write visible at once."""
    stores.withColumn("write_id", F.lit(write_id)).write.mode("append").partitionBy("write_id").parquet(os.path.join(path, "stores"))
    seq = _commits(spark, path).agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0] + 1
    spark.createDataFrame([(write_id, seq, version)], COMMIT).coalesce(1).write.mode("append").parquet(os.path.join(path, "commits"))


def _visible(spark: SparkSession, path: str) -> DataFrame:
    """Store rows of committed writes since each store's last replacement."""
    commits = _commits(spark, path)
    fs, at = _folder(spark, os.path.join(path, "stores"))
    if not fs.exists(at):
        rows = spark.createDataFrame([], f"{COUNTS}, write_id string")
    else:
        rows = spark.read.schema(f"{COUNTS}, write_id string").parquet(os.path.join(path, "stores"))
    order = F.struct("seq", "write_id")
    rows = rows.join(commits.select("write_id", "seq"), "write_id").withColumn("at", order)
    since = rows.where("replaces").groupBy("store_id").agg(F.max("at").alias("since"))
    return rows.join(since, "store_id", "left").where("(since is null or at >= since) and not deleted")


def write_index(docs: DataFrame, path: str, append: bool = False, metadata: dict[str, str] | None = None, version: object = None,
                splitter: str = "recursive", **given) -> bool:
    """V3 + S8: index ``docs`` (store_id, doc_id, text) as one unit: chunks as
    ``build_chunks`` makes them and a row of counters and the metadata per store.  The
    stores named are replaced, or with ``append`` added to; others stay.  A store
    without chunks is a store too.

    ``version`` names the write (a batch id of a stream, say): when a write of that name
    is committed already, nothing is written and the answer is False."""
    spark, name = docs.sparkSession, None if version is None else str(version)
    if name is not None and not _commits(spark, path).where(F.col("version") == name).isEmpty():
        return False
    docs = docs.withColumn("store_id", F.col("store_id").cast("string"))
    write_id, chunks = f"w{uuid.uuid4().hex}", os.path.join(path, "chunks")
    _placed(build_chunks(docs, splitter=splitter, **given)).withColumn("write_id", F.lit(write_id)) \
        .write.mode("append").partitionBy("write_id", "store_part").parquet(chunks)
    written = spark.read.schema("store_id string, write_id string").parquet(chunks).where(F.col("write_id") == write_id)
    meta = F.create_map(*[x for k, v in (metadata or {}).items() for x in (F.lit(k), F.lit(v))]).cast("map<string,string>")
    sizes = docs.groupBy("store_id").agg(F.count("*").alias("num_docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint").alias("total_chars"))
    counts = written.groupBy(F.col("store_id").alias("of")).agg(F.count("*").alias("num_chunks"))
    rows = sizes.join(counts, F.col("store_id").eqNullSafe(F.col("of")), "left").select(
        "store_id", "num_docs", "total_chars", F.coalesce("num_chunks", F.lit(0)).alias("num_chunks"),
        F.lit(V.EMBEDDING_MODEL).alias("embedding_model"), meta.alias("metadata"), F.lit(not append).alias("replaces"), F.lit(False).alias("deleted"))
    _commit(spark, path, write_id, rows, name)
    return True


def read_stores(spark: SparkSession, path: str) -> DataFrame:
    """V7 + V8: per store of an index its counters over all writes since it was last
    replaced, the embedding model and the metadata of the latest write."""
    return _visible(spark, path).groupBy("store_id").agg(
        *[F.sum(c).alias(c) for c in ("num_docs", "num_chunks", "total_chars")],
        F.max_by("embedding_model", "at").alias("embedding_model"), F.max_by("metadata", "at").alias("metadata"))


def read_index(spark: SparkSession, path: str, store_id: str | None = None) -> DataFrame:
    """The chunks of an index that committed writes show; a store id prunes to its
    partitions."""
    fs, at = _folder(spark, os.path.join(path, "chunks"))
    if not fs.exists(at):
        raise FileNotFoundError(f"no index at {path}")
    chunks = spark.read.parquet(os.path.join(path, "chunks"))
    if store_id is not None:
        chunks = chunks.where(F.col("store_part") == F.lit(f"s{store_id}"))
    seen = _visible(spark, path).select("write_id", F.col("store_id").alias("of")).distinct()
    return chunks.join(seen, (chunks["write_id"] == seen["write_id"]) & chunks["store_id"].eqNullSafe(seen["of"]), "left_semi") \
        .drop("write_id", "store_part")


def delete_index(spark: SparkSession, path: str, store_id: str) -> bool:
    """V9: a committed write that leaves the store out; True if it was there.  Its
    files go with ``vacuum_index``."""
    there = not _visible(spark, path).where(F.col("store_id") == F.lit(store_id)).isEmpty()
    if there:
        gone = spark.createDataFrame([(store_id, 0, 0, 0, V.EMBEDDING_MODEL, {}, True, True)], COUNTS)
        _commit(spark, path, f"w{uuid.uuid4().hex}", gone, None)
    return there


def vacuum_index(spark: SparkSession, path: str) -> int:
    """Removes the folders of writes that show nothing (stopped, replaced or deleted);
    the number removed.  Run it while nothing writes to the index."""
    shown = {r[0] for r in _visible(spark, path).select("write_id").distinct().collect()}  # one name per write
    kept, removed = {r[0] for r in _commits(spark, path).select("write_id").collect()}, 0
    for part, names in (("chunks", shown), ("stores", kept)):
        fs, at = _folder(spark, os.path.join(path, part))
        for entry in fs.listStatus(at) if fs.exists(at) else []:
            name = entry.getPath().getName()
            if name.startswith("write_id=") and name[len("write_id="):] not in names:
                removed += bool(fs.delete(entry.getPath(), True))
    return removed


def query_index(spark: SparkSession, path: str, queries: DataFrame, query_key: str, top_k: int = V.DEFAULT_TOP_K) -> DataFrame:
    """V4-V6 + V11 over a stored index: one row per query (query_key, store_id,
    embedding) with status, chunks and scores in rank order and the store's
    metadata; an unknown store answers 'not found' without them."""
    stores, chunks = read_stores(spark, path), read_index(spark, path)
    hits = query_stores(queries, chunks, query_key, top_k, stores).where("status = 'ok'")
    found = hits.join(chunks.select("store_id", "doc_id", "chunk_no", "chunk"), ["store_id", "doc_id", "chunk_no"])
    packed = V.pack_results(found, query_key)
    out = queries.select(query_key, "store_id").join(stores.select("store_id", "metadata", F.lit("ok").alias("_s")), "store_id", "left") \
        .join(packed, query_key, "left")
    empty = lambda c, t: F.when(F.col("_s").isNotNull(), F.coalesce(c, F.array().cast(t)))
    return out.select(query_key, "store_id", F.coalesce("_s", F.lit(NOT_FOUND)).alias("status"),
                      empty("chunks", "array<string>").alias("chunks"), empty("scores", "array<double>").alias("scores"), "metadata")


def query_stores(queries: DataFrame, chunks: DataFrame, query_key: str, top_k: int = V.DEFAULT_TOP_K,
                 stores: DataFrame | None = None) -> DataFrame:
    """V4 + V11: each query (query_key, store_id, embedding) searches only
    its own store; a query naming an unknown store gets one row with status
    'not found'.  ``stores`` lists the known store ids (default: those in
    ``chunks``).  Output: query_key, store_id, status, rank, doc_id,
    chunk_no, distance, score."""
    known = (stores if stores is not None else chunks).select("store_id").distinct()
    q = queries.join(known, "store_id", "left_semi")
    missing = queries.join(known, "store_id", "left_anti").select(
        query_key, "store_id", F.lit(NOT_FOUND).alias("status"))
    hits = V.knn(q, chunks, query_key, ["doc_id", "chunk_no"], top_k=top_k, within=["store_id"])
    hits = hits.join(queries.select(query_key, "store_id"), query_key).withColumn("status", F.lit("ok"))
    return hits.unionByName(missing, allowMissingColumns=True)


def write_results(jobs: DataFrame, path: str, key: str = "job_id", batch: object = None) -> None:
    """Job results as JSON lines (a result document with its ``key`` per job)
    partitioned by batch and status; one file per task, never one file per job.  Earlier
    batches at ``path`` stay.  A batch of the same name is replaced, so a batch that is
    run again leaves its results once; without a name each call is a batch of its own."""
    if key not in jobs.columns:
        raise ValueError(f"no column {key}")
    name = f"b{uuid.uuid4().hex if batch is None else batch}"
    jobs.select("status", F.to_json(F.struct(*jobs.columns)).alias("value")).write.mode("overwrite").partitionBy("status") \
        .text(os.path.join(path, f"batch={name}"))


def read_results(spark: SparkSession, path: str, deleted: DataFrame | None = None, key: str = "job_id") -> DataFrame:
    """(key, status, value) of the results at ``path``, without those of the
    keys in ``deleted`` (J5: a job's output goes with it)."""
    found = spark.read.schema("value string, batch string, status string").text(path) \
        .withColumn(key, F.get_json_object("value", f"$.{key}")).select(key, "status", "value")
    return found if deleted is None else found.join(deleted.select(F.col(key).cast("string")).distinct(), key, "left_anti")


def compact_results(spark: SparkSession, path: str, out: str, deleted: DataFrame, key: str = "job_id") -> None:
    """The results at ``path`` that are left without ``deleted``, written to ``out``."""
    read_results(spark, path, deleted, key).select(F.lit("ball").alias("batch"), "status", "value") \
        .write.mode("errorifexists").partitionBy("batch", "status").text(out)
