"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets split on another bit.

Bits 1 to 32 come from the MD5 of id and text, so they are the same everywhere; bits 33 to 48 from the place of a row in its
input, so that also rows that repeat id and text can be split. The directory is a table: each round sums bytes by the next
STEP bits of the rows in buckets still over the limit, and keeps the shallowest prefixes that fit.

Defined results: null texts have 0 bytes and a null id hashes as empty text; repeated rows are rows of their own; a row that
alone exceeds the limit gets the full 48 bits; an empty table gives no rows; extra columns are ignored by assign() and kept by write().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.storage import stage

BITS, CONTENT_BITS, STEP = 48, 32, 4
LIMIT = 16 << 20


def content_bits(doc_id: str, text: str) -> Column:
    body = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(body), 1, CONTENT_BITS // 4), 16, 10).cast("long")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    salt = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << BITS - CONTENT_BITS) - 1))
    key = F.shiftleft(content_bits(doc_id, text), BITS - CONTENT_BITS).bitwiseOR(salt)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return docs.withColumns({"__key": key, "__size": size})


def _prefix(depth: int | Column) -> Column:
    shift = F.lit(BITS) - depth
    return F.call_function("shiftright", F.col("__key"), shift.cast("int"))


def directory(keys: DataFrame, limit: int) -> DataFrame:
    """(depth, prefix, shard_bytes, rows): the buckets, none over limit unless it has all bits."""
    total = keys.agg(F.coalesce(F.sum("__size"), F.lit(0)).alias("shard_bytes"), F.count("*").alias("rows"))
    size = total.first()[0]
    if size <= limit:
        return total.filter("rows > 0").select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), "shard_bytes", "rows")
    found, base, rows = [], 0, keys
    while True:
        top = min(base + STEP, BITS)
        depths = F.explode(F.array(*(F.lit(d) for d in range(base + 1, top + 1))))
        each = rows.withColumn("depth", depths).withColumn("prefix", _prefix(F.col("depth")))
        sums = stage(each.groupBy("depth", "prefix").agg(F.sum("__size").alias("shard_bytes"), F.count("*").alias("rows")), "buckets")
        over = sums.filter(F.col("shard_bytes") > limit)
        parents = over.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        done = F.col("shard_bytes") <= limit if top < BITS else (F.col("shard_bytes") <= limit) | (F.col("depth") == BITS)
        fits = sums.filter(done).withColumn("parent", F.shiftright("prefix", 1))
        found += [fits.filter(F.col("depth") == base + 1).drop("parent"), fits.join(parents, ["depth", "parent"], "left_semi").drop("parent")]
        still = over.filter(F.col("depth") == top).select("prefix")
        if top == BITS or still.isEmpty():
            return stage(reduce(DataFrame.unionByName, found), "directory")
        rows = keys.withColumn("prefix", _prefix(F.lit(top))).join(still, "prefix", "left_semi").drop("prefix")
        base = top


def _shards(keyed: DataFrame, buckets: DataFrame) -> DataFrame:
    """Each row meets the bucket that its key starts with, by equality on depth and prefix for the depths that occur."""
    depths = sorted(r.depth for r in buckets.select("depth").distinct().collect())  # 49 at most
    name = F.when(F.col("depth") > 0, F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0"))).otherwise("")
    named = buckets.select(F.col("depth").alias("__depth"), F.col("prefix").alias("__prefix"), name.alias("__shard"), F.col("shard_bytes").alias("__bytes"))
    if len(depths) <= 1:
        tried = keyed.withColumn("__depth", F.lit(depths[0] if depths else 0))
    else:
        tried = keyed.withColumn("__depth", F.explode(F.array(*map(F.lit, depths))))
    return tried.withColumn("__prefix", _prefix(F.col("__depth"))).join(named, ["__depth", "__prefix"])


def assign(docs: DataFrame, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, shard, depth, n_bytes, shard_bytes); shard: the bits that lead to it."""
    rows = _keyed(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")), "doc_id", "text").drop("text")
    keyed = stage(rows, "keys")
    found = _shards(keyed, directory(keyed.select("__key", "__size"), limit))
    return found.select("doc_id", F.col("__shard").alias("shard"), F.col("__depth").alias("depth"), F.col("__size").alias("n_bytes"), F.col("__bytes").alias("shard_bytes"))


def write(docs: DataFrame, path: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the rows as Parquet, a folder a shard, and return the directory. Columns named as those that this adds are an error."""
    if clash := {c.lower() for c in docs.columns} & {"__key", "__size", "__shard", "__depth", "__bytes"}:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    keyed = stage(_keyed(docs, doc_id, text), "keyed")
    buckets = directory(keyed.select("__key", "__size"), limit)
    out = _shards(keyed, buckets).select(*docs.columns, F.concat(F.lit("b"), "__shard").alias("__shard"))
    out.repartition("__shard").write.partitionBy("__shard").parquet(path)
    return buckets


def oracle(limit: int = LIMIT) -> str:
    """The assignment in DuckDB SQL, for tables whose buckets fit within the content bits."""
    return f"""
    WITH keys AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce(strlen(text), 0) AS n_bytes,
               ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 8))::BIGINT AS k FROM documents),
    tried AS (SELECT r, n_bytes, depth, k >> CAST({CONTENT_BITS} - depth AS INTEGER) AS prefix FROM keys, range({CONTENT_BITS + 1}) AS t(depth)),
    sums AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes FROM tried GROUP BY ALL HAVING shard_bytes <= {limit}),
    leaf AS (SELECT r, min(depth) AS depth FROM tried JOIN sums USING (depth, prefix) GROUP BY r)
    SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INTEGER), '0') END AS shard, CAST(depth AS INTEGER) AS depth, n_bytes, shard_bytes
    FROM leaf JOIN keys USING (r) JOIN tried USING (r, depth, n_bytes) JOIN sums USING (depth, prefix)"""
