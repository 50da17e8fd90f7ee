"""Exact deduplication as a stateful stream.

The documents are reduced to a ledger (digest, identifier, content locator) that a
structured-streaming query folds into disk-backed keyed state (RocksDB) without
expiry: for every digest the number of rows and the identifier and locator of the row
that stays. The state is read back as a table. Where the state reports a hit (several
rows under one digest) the full bytes of those rows are compared; rows whose bytes
differ under one digest are grouped again by their text.

Only digests and locators pass through the state. The digests that were hit are sent to
the scan as 64-bit hashes if they stay below a bound, so that no text but those of hits
is moved; beyond the bound the texts meet them in salted parts. Partial aggregation runs
before each shuffle, so one group may hold a third of all rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import exists, moved
from .common import ROW_BYTES, SHARED_BYTES, ascii_lower, keep_rows, located, quoted, shared_folder, written

#: State on disk. Without preallocation many small stores take little of it; changes are
#: uploaded as a changelog instead of whole snapshots. All stores of an executor share a
#: bounded native memory, and are closed as soon as their task has committed.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Parts in which the texts of one digest are compared where they have to be moved.
SALTS = 16


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def fold_into_state(spark: SparkSession, ledger_path: str, schema, checkpoint: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Fold all new ledger files into the keyed state at `checkpoint`; return the state.

    Called again with the same checkpoint it reads only files that were added since:
    a restarted job neither counts a row twice nor forgets a digest.
    """
    before = {key: spark.conf.get(key, None) for key in STATE_CONF}
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        reader = spark.readStream.schema(schema)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        state = (
            reader.parquet(ledger_path)
            .groupBy("digest")
            .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "file", "pos")).alias("keep"))
        )
        query = (
            state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)
    stored = spark.read.format("statestore").load(checkpoint)
    count, keep = stored.schema["value"].dataType.fieldNames()[:2]
    return stored.select(
        F.col("key.digest").alias("digest"),
        F.col("value").getField(count).alias("group_size"),
        F.col("value").getField(keep).alias("keep"),
    )


def _texts_of(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """Those of texts(digest, ...) whose digest has the hash of a hit."""
    hashes = written(hits.select(F.xxhash64("digest").alias("_h")).distinct(), "dedup-hits")
    texts = texts.withColumn("_h", F.xxhash64("digest"))
    if hashes.count() * ROW_BYTES <= SHARED_BYTES:
        return texts.join(F.broadcast(hashes), "_h", "left_semi").drop("_h")
    salted = hashes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("file", "pos"), F.lit(SALTS)).cast("int")
    return texts.withColumn("_salt", salt).join(salted, ["_h", "_salt"], "left_semi").drop("_h", "_salt")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest=sha256_hex,
    max_files_per_trigger: int | None = None,
    checkpoint: str | None = None,
    batch: str | None = None,
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, file, pos.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty.
    Of equal texts the row with the largest identifier stays (a null identifier is the
    smallest). Rows with the same identifier and text tie; then the locator decides, so
    exactly one row of a group has kept = true. An empty table gives an empty result.
    Further columns of docs, whatever their names, are not read. `digest` maps the
    normalised text column to the key of the state; any key gives the right result.

    With `checkpoint`, a folder that all executors reach, ledger and state stay there: a
    later call with the same folder counts its rows to those of all calls before, whose
    texts it reads again by their locators where a digest is hit. So their files, Parquet
    with a column text_col, must still be there. A call is known by `batch`, by default
    its plan and input files: the same call again, after one that failed or not, counts
    its rows once. (A table that isn't a file scan has to be given a name for that.)
    """
    name = batch or (_batch_name(docs) if checkpoint else None)
    rows = located(docs, "dedup-input")
    return _marked(rows, id_col, text_col, digest, max_files_per_trigger, checkpoint, name)


def _batch_name(docs: DataFrame) -> str:
    """The same for the same plan over the same files."""
    plan = re.sub(r"#\d+L?", "", docs._jdf.queryExecution().analyzed().toString())
    return hashlib.sha256("\n".join([plan, *sorted(docs.inputFiles())]).encode()).hexdigest()[:32]


def _marked(located_rows: DataFrame, id_col: str, text_col: str, digest=sha256_hex, max_files_per_trigger: int | None = None, checkpoint: str | None = None, batch: str | None = None) -> DataFrame:
    spark = located_rows.sparkSession
    folder, batch = checkpoint or shared_folder(spark, "dedup"), batch or uuid.uuid4().hex
    norm = ascii_lower(F.col(f"row.{quoted(text_col)}").cast("string"))
    rows = located_rows.select(F.col(f"row.{quoted(id_col)}").cast("long").alias("doc_id"), "file", "pos", digest(norm).alias("digest"), norm.alias("norm"))
    entry = rows.select("doc_id", "file", "pos", sha256_hex(F.col("norm")).alias("text_sha256"), "digest", F.lit(batch).alias("batch"))
    # a batch appears among the others as a whole, once; what is there from an earlier try is taken as it is
    if not exists(spark, f"{folder}/ledger/{batch}"):
        entry.write.mode("overwrite").parquet(f"{folder}/unfinished/{batch}")
        moved(spark, f"{folder}/unfinished/{batch}", f"{folder}/ledger/{batch}")
    ledger = spark.read.schema(entry.schema).parquet(f"{folder}/ledger/*")
    mine = spark.read.schema(entry.schema).parquet(f"{folder}/ledger/{batch}").drop("batch")
    state = fold_into_state(spark, f"{folder}/ledger/*", ledger.schema, f"{folder}/state", max_files_per_trigger)
    marked = written(mine.join(state, "digest"), "dedup-marked")

    hits = marked.filter("group_size > 1").select("digest").distinct()
    found = _texts_of(rows, hits)
    if checkpoint:
        old = ledger.filter(F.col("batch") != batch).join(hits, "digest", "left_semi").select("doc_id", "file", "pos", "digest")
        files = [r["file"] for r in old.select("file").distinct().collect()]  # paths of input files
        if files:
            before = located(spark.read.parquet(*files), "dedup-before").select("file", "pos", norm.alias("norm"))
            found = found.unionByName(old.join(before, ["file", "pos"]))
    checked = found.groupBy("digest").agg((F.min("norm") == F.max("norm")).alias("same"))
    collided = written(checked.filter(~F.col("same")).select("digest"), "dedup-collisions")
    if not collided.isEmpty():
        marked = marked.join(collided, "digest", "left_anti").unionByName(_by_text(marked, found, collided))
    return marked.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        ((F.col("keep.file") == F.col("file")) & (F.col("keep.pos") == F.col("pos"))).alias("kept"),
        "text_sha256",
        "file",
        "pos",
    )


def _by_text(marked: DataFrame, found: DataFrame, collided: DataFrame) -> DataFrame:
    """Rows of digests that stand for several texts, grouped by the text itself."""
    texts = written(found.join(collided, "digest", "left_semi"), "dedup-collided")
    groups = texts.groupBy("norm").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "file", "pos")).alias("keep"))
    mine = marked.join(collided, "digest", "left_semi").drop("group_size", "keep")
    return mine.join(texts.select("file", "pos", "norm"), ["file", "pos"]).join(groups, "norm").drop("norm")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns."""
    rows = located(docs, "dedup-input")
    return keep_rows(rows, _marked(rows, id_col, text_col))
