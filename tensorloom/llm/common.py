"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled as written
from ..session import shared_path as shared_folder

__all__ = ["ascii_lower", "hash_sample", "keep_rows", "located", "looked_up", "map_batches", "quoted", "read_table", "shared", "shared_folder", "tokenizer_path", "written"]

#: White space of the word rule, and words themselves, as Java regular expressions.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of a batch that a Python worker gets at most.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def map_batches(rows: DataFrame, run, schema: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """rows.mapInArrow(run, schema) with batches bounded in rows and bytes.

    A text may have any length; with the default bound of rows alone a batch of long
    texts could outgrow a worker. The bounds are options of the session and stay set.
    """
    conf = rows.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)


def hash_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """About the n rows with the smallest hash of keys, the same ones however df is partitioned.

    Rows above a threshold that leaves some four times n are dropped where they are read,
    so what partitions send on to be ordered doesn't grow with the table.
    """
    total = df.count()
    h = F.xxhash64(*keys).bitwiseAND((1 << 63) - 1)
    if total > 8 * n:
        df = df.filter(h < int((1 << 63) * (4 * n / total)))
    return df.orderBy(h, *keys).limit(n)


def ascii_lower(text: Column) -> Column:
    """text with A-Z alone lower-cased; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


#: Plan nodes that keep the rows of a scan apart, each with its own locator.
ROW_WISE = ("Project", "Filter", "SubqueryAlias")


def _is_scan(df: DataFrame) -> bool:
    """Whether df is a file scan with nothing but projections and filters above it."""
    try:
        df.select(df.metadataColumn("_metadata")["row_index"]).schema
    except AnalysisException:
        return False
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ROW_WISE:
        plan = plan.children().head()
    return plan.nodeName().startswith("Relation") or plan.nodeName() == "LogicalRelation"


def quoted(name: str) -> str:
    """A column's name as it stands in an expression, whatever its characters."""
    return "`" + name.replace("`", "``") + "`"


def located(docs: DataFrame, purpose: str) -> DataFrame:
    """row (all columns of docs as a struct), file, pos: every row with a locator of its own.

    Rows of a plain file scan are located where they lie; other tables (joins, unions,
    generated rows) are written first.
    """
    if not _is_scan(docs):
        docs = written(docs, purpose)
    place = docs.metadataColumn("_metadata")
    columns = [F.col(quoted(c)) for c in docs.columns]
    return docs.select(F.struct(*columns).alias("row"), place["file_path"].alias("file"), place["row_index"].alias("pos"))


#: Bytes of a table that is sent to all executors, at most.
SHARED_BYTES = 64 << 20
#: Bytes that a row of a few numbers takes in a shared table, about.
ROW_BYTES = 48


def shared(df: DataFrame, rows: int, row_bytes: int = ROW_BYTES) -> DataFrame:
    """df, for broadcast if its `rows` rows stay below the bound; else the join shuffles."""
    return F.broadcast(df) if rows * row_bytes <= SHARED_BYTES else df


#: Parts into which the rows of a key are dealt where a table is too large to be shared.
SALTS = 16


def looked_up(rows: DataFrame, table: DataFrame, n_rows: int, keys: list[str], salt, row_bytes: int = ROW_BYTES) -> DataFrame:
    """rows left-joined with table (one row a key), which is shared if its n_rows stay below the bound.

    Else the rows of each key are dealt into parts by the hash of `salt`, so that a hot key
    meets its row in many tasks.
    """
    if n_rows * row_bytes <= SHARED_BYTES:
        return rows.join(F.broadcast(table), keys, "left")
    dealt = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(dealt, [*keys, "_salt"], "left").drop("_salt")


def keep_rows(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """The columns of those rows (row, file, pos) that decided (file, pos, kept) keeps.

    The smaller of both sides, the rows that go or those that stay, is sent to the scan if
    it stays below a bound, so that no text is moved; else both meet by locator. A file is
    known by a 64-bit hash of its path.
    """
    key = [F.xxhash64("file").alias("_f"), F.col("pos").alias("_p")]
    decided = written(decided.select(*key, "kept"), "decided")
    n, kept = decided.agg(F.count(F.lit(1)), F.count_if("kept")).first()
    gone = n - kept <= kept
    side = decided.filter(~F.col("kept") if gone else F.col("kept")).select("_f", "_p")
    held = rows.select("row", *key).join(shared(side, n - kept if gone else kept), ["_f", "_p"], "left_anti" if gone else "left_semi")
    return held.select("row.*")


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file, which every worker has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)
