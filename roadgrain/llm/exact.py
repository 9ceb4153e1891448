"""Exact duplicates by an extendible-hash index on shared files.

Keys are the leading bits of the normalised text's SHA-256. Distinct keys are counted per slot of
a directory; a bucket that holds too many is split by one more bit, which doubles the directory,
until each holds its share. Directory and buckets are Parquet tables in the shared folder, sorted
by bucket, so that owner tasks hold ranges of the key. Texts whose key occurs once are done. The
others are chained under their key and compared byte for byte; a collision is a further link of
the chain. Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrain.llm.shared import SPACE_RUN, documents, free_name, stored, text_or_empty

#: Bits of the key.
KEY_BITS = 60
#: Distinct keys that a bucket holds before it is split.
BUCKET_KEYS = 200_000
#: A key with more than this share of all rows is dealt to several tasks; so there are at most this many.
HOT_SHARE = 2_000
#: Fewer rows than this are never dealt out.
HOT_ROWS = 500
#: Bits by which the counted slots are finer than the buckets expected.
SPARE_BITS = 3


def normalised(column: str = "text") -> Column:
    """The text with each run of white space as one space; NULL as the empty text."""
    return F.regexp_replace(text_or_empty(column), SPACE_RUN, " ")


def text_keys(df: DataFrame, id_col: str, text_col: str, key_bits: int) -> DataFrame:
    """doc_id, row number, normalised text, its digest and key."""
    rows = df.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"))
    sha = rows.withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
    first = F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("bigint")
    return sha.withColumn("key", F.shiftright(first, 60 - key_bits)).withColumn("row", F.monotonically_increasing_id())


def directory(counts: DataFrame, key_bits: int, bucket_keys: int, keys: int) -> DataFrame:
    """Slot -> bucket and local depth.

    Splitting stops at the least depth at which a prefix holds at most ``bucket_keys`` distinct
    keys, or at the depth of the slots; many slots may name one bucket. A bucket's number is its
    first slot, so buckets are in the order of their keys.
    """
    depth = min(key_bits, max(0, math.ceil(math.log2(max(1, keys / bucket_keys)))) + SPARE_BITS)
    slots = counts.groupBy(F.shiftright("key", key_bits - depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    level = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth")
    nodes = slots.select("slot", "n", level).withColumn("prefix", F.expr(f"shiftright(slot, {depth} - depth)"))
    held = nodes.groupBy("depth", "prefix").agg(F.sum("n").alias("n"))
    fits = held.filter((F.col("n") <= bucket_keys) | (F.col("depth") == depth)).select("depth", "prefix")
    least = nodes.join(fits, ["depth", "prefix"]).groupBy("slot").agg(F.min("depth").alias("depth"))
    first = F.expr(f"shiftleft(shiftright(slot, {depth} - depth), {depth} - depth)")
    return least.select("slot", F.col("depth").alias("local_depth"), first.alias("bucket"), F.lit(key_bits - depth).alias("shift"))


def build_index(df: DataFrame, id_col: str, text_col: str, key_bits: int, bucket_keys: int) -> tuple[DataFrame, int]:
    """The stored buckets (bucket, key, n), in key order, and the number of rows of ``df``."""
    counts = text_keys(df, id_col, text_col, key_bits).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "keys")
    found = counts.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    slots = stored(directory(counts, key_bits, bucket_keys, found["keys"]), "directory")
    shift = slots.select("shift").first()
    slot = F.shiftright("key", shift["shift"] if shift else 0)
    buckets = counts.withColumn("slot", slot).join(slots.select("slot", "bucket", "local_depth"), "slot")
    index = buckets.select("bucket", "local_depth", "key", "n").repartitionByRange("bucket", "key")
    return stored(index, "buckets", order_within=["bucket", "key"]), found["rows"]


def exact_duplicates(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    key_bits: int = KEY_BITS,
    bucket_keys: int = BUCKET_KEYS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are; the row with the smallest id stays, and of rows
    that repeat both id and text one stays. NULL texts equal the empty text. A NULL id is never the
    smallest unless all ids of its group are NULL; then one of these rows stays and keep_id is NULL.
    An empty table gives no rows; other columns are not read.
    """
    index, rows = build_index(df, id_col, text_col, key_bits, bucket_keys)
    limit = max(hot_rows, rows // HOT_SHARE)
    repeated = index.filter("n > 1").select("bucket", "key", F.ceil(F.col("n") / limit).alias("deals"))
    hot = stored(repeated.filter("deals > 1").select("key", "deals"), "hot")  # at most HOT_SHARE keys
    deal = F.expr("pmod(xxhash64(row), deals)")

    keyed = text_keys(df, id_col, text_col, key_bits).join(F.broadcast(hot), "key", "left")
    keyed = keyed.withColumn("deal", F.coalesce(deal, F.lit(0))).drop("deals")
    dealt = repeated.withColumn("deal", F.explode(F.expr("sequence(0L, deals - 1)")))
    chained = keyed.join(dealt.hint("shuffle_hash"), ["key", "deal"], "left")
    chained = chained.withColumn("norm", F.when(F.col("bucket").isNotNull(), F.col("norm")))
    chains = stored(chained.select("doc_id", "row", "text_sha256", "bucket", "key", "deal", "deals", "norm"), "chains")

    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("row")))
    links = chains.filter("norm is not null").groupBy("bucket", "key", "norm")
    links = links.agg(F.count(F.lit(1)).alias("group_size"), least.alias("first"), F.max("deals").alias("deals"))
    links = links.withColumn("deal", F.explode(F.expr("sequence(0L, deals - 1)"))).drop("deals", "bucket")
    copies = chains.filter("norm is not null").drop("deals", "bucket").join(links.hint("shuffle_hash"), ["key", "deal", "norm"])
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    copies = copies.withColumns({"keep_id": F.col("first.id"), "kept": F.col("row") == F.col("first.row")}).select(*out)
    single = {"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("bigint"), "kept": F.lit(True)}
    return chains.filter("norm is null").withColumns(single).select(*out).unionByName(copies)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def keep_first(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns; rows that repeat id and text are one.

    Rows that go are named by id and digest, so a row with the id of a copy but another text stays.
    """
    found = exact_duplicates(df, id_col=id_col, text_col=text_col)
    named = [F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")]
    gone = found.filter("not kept and not doc_id <=> keep_id").select(*named).distinct()
    repeated = found.filter("not kept and doc_id <=> keep_id").select(*named).distinct()
    sha = free_name(df, "__text_sha")
    rows = df.withColumn(sha, F.sha2(normalised(text_col).cast("binary"), 256))

    def same(other: DataFrame) -> Column:
        return rows[id_col].eqNullSafe(other["__id"]) & (rows[sha] == other["__sha"])

    rows = rows.join(gone, same(gone), "left_anti")
    once = rows.join(repeated, same(repeated), "left_semi").dropDuplicates([id_col, sha])
    return rows.join(repeated, same(repeated), "left_anti").unionByName(once).drop(sha)


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
