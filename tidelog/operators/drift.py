"""Schema drift, key-set drift, and conforming rows to a declared schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.cdc import CDC_COLUMNS
from tidelog.functions.typemap import spark_type, type_signature
from tidelog.session import small_table

CHANGES = ("ADD", "DROP", "TYPE", "POSSIBLE_RENAME")


def _signed(columns: DataFrame) -> DataFrame:
    """Column metadata as (fqn, column_name, data_type, signature), one row per column."""
    name = lambda c: F.upper(F.trim(F.col(c)))
    return columns.select(
        F.concat_ws(".", name("owner"), name("table_name")).alias("fqn"),
        name("column_name").alias("column_name"),
        name("data_type").alias("data_type"),
        type_signature(*[F.col(c) for c in ("data_type", "data_length", "data_precision", "data_scale")]).alias("signature"),
    )


def schema_diff(current: DataFrame, previous: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Column changes between two metadata snapshots, one row per change.

    Tables in one snapshot only are skipped. One added and one dropped column
    with equal signatures count as a possible rename. Adding is safe, the rest
    needs review.
    """
    cur, prev = _signed(current), _signed(previous)
    if only is not None:
        cur, prev = (side.join(only.select("fqn").distinct(), "fqn", "left_semi") for side in (cur, prev))
    as_side = lambda df, p: df.select(
        "fqn", "column_name", F.col("data_type").alias(f"{p}_type"), F.col("signature").alias(f"{p}_signature")
    )
    both = as_side(prev, "old").join(as_side(cur, "new"), ["fqn", "column_name"], "full_outer")
    kind = (
        F.when(F.col("old_signature").isNull(), "ADD")
        .when(F.col("new_signature").isNull(), "DROP")
        .when(F.col("old_signature") != F.col("new_signature"), "TYPE")
    )
    both = both.withColumn("change", kind)

    count = lambda word: F.count_if(F.coalesce(F.col("change") == word, F.lit(False)))
    only_one = lambda word, c: F.max(F.when(F.col("change") == word, F.col(c)))
    tables = (
        both.groupBy("fqn")
        .agg(
            (F.count("old_signature") > 0).alias("__was"),
            (F.count("new_signature") > 0).alias("__is"),
            (
                (count("ADD") == 1) & (count("DROP") == 1)
                & (only_one("ADD", "new_signature") == only_one("DROP", "old_signature"))
            ).alias("__renamed"),
            only_one("ADD", "column_name").alias("__new_name"),
            only_one("ADD", "new_type").alias("__new_type"),
        )
        .where("__was AND __is")
    )
    rows = both.where("change IS NOT NULL").join(tables, "fqn")
    # Of a renamed pair the dropped column carries the row.
    renamed = F.col("__renamed") & (F.col("change") == "DROP")
    change = F.when(renamed, "POSSIBLE_RENAME").otherwise(F.col("change"))
    return rows.where(~(F.col("__renamed") & (F.col("change") == "ADD"))).select(
        "fqn",
        change.alias("change"),
        "column_name",
        F.when(renamed, F.col("__new_name")).alias("renamed_to"),
        "old_type",
        F.when(renamed, F.col("__new_type")).otherwise(F.col("new_type")).alias("new_type"),
        F.when(change == "ADD", "SAFE").otherwise("WARN").alias("severity"),
    )


def schema_diff_summary(changes: DataFrame) -> DataFrame:
    return changes.agg(
        F.count_distinct("fqn").alias("tables"),
        F.count_if(F.col("severity") == "SAFE").alias("safe"),
        F.count_if(F.col("severity") == "WARN").alias("warnings"),
    )


def declared_diff(metadata: DataFrame, stored: T.StructType) -> DataFrame:
    """Names-only comparison of one table's metadata with a stored table's schema.

    The CDC columns exist only in the stored table and are ignored.
    """
    spark = metadata.sparkSession
    ignored = [c.upper() for c in CDC_COLUMNS]
    names = [(f.name.upper(),) for f in stored.fields if f.name.upper() not in ignored]
    have = small_table(spark, names, "column_name string").withColumn("__stored", F.lit(True))
    want = metadata.select(F.upper(F.trim("column_name")).alias("column_name")).distinct()
    want = want.where(~F.col("column_name").isin(*ignored)).withColumn("__declared", F.lit(True))
    both = want.join(have, "column_name", "full_outer").where("__stored IS NULL OR __declared IS NULL")
    return both.select("column_name", F.when(F.col("__stored").isNull(), "ADD").otherwise("DROP").alias("change"))


def evolve(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, list[tuple[str, str, str]]]:
    """Union where new columns become typed nulls in old rows and nothing is dropped.

    Columns whose types differ keep the old type; values that do not fit become
    null. Returns (union, rejects, clashes): the new rows with such values, raw, with a
    ``reason``, and the clashes (column, old type, new type) for review.
    """
    types = {f.name: f.dataType for f in old.schema.fields}
    clashes = [
        (f.name, types[f.name].simpleString(), f.dataType.simpleString())
        for f in new.schema.fields
        if f.name in types and types[f.name] != f.dataType
    ]
    cast = {c: F.col(c).try_cast(types[c]) for c, _, _ in clashes}
    fitted = new.select(*[cast[c].alias(c) if c in cast else F.col(c) for c in new.columns])
    union = old.unionByName(fitted, allowMissingColumns=True)
    return union, _cast_failures(new, cast).where("reason IS NOT NULL"), clashes


def _cast_failures(rows: DataFrame, cast: dict[str, Column]) -> DataFrame:
    """``rows`` with a ``reason`` naming the columns whose cast fails; null if none does."""
    failing = [F.when(F.col(n).isNotNull() & c.isNull(), F.lit(n)) for n, c in cast.items()]
    names = F.concat_ws(",", *failing) if failing else F.lit("")
    return rows.withColumn("reason", F.when(names != "", F.concat(F.lit("cast failed: "), names)))


def conform(rows: DataFrame, columns: list[tuple[str, str, int | None, int | None]]) -> tuple[DataFrame, DataFrame]:
    """Cast raw rows to declared source types; rows with a failed cast go aside.

    ``columns`` lists (name, source type, precision, scale). Returns (good, bad);
    bad rows keep their raw values and name the failing columns.
    """
    cast = {n: F.col(n).try_cast(spark_type(t, p, s)) for n, t, p, s in columns}
    marked = _cast_failures(rows, cast)
    good = marked.where("reason IS NULL").select(*[c.alias(n) for n, c in cast.items()])
    return good, marked.where("reason IS NOT NULL")


def _hashed(keys: list[str]) -> Column:
    """Salted: the hash that chooses the bucket has the same low bits in all of it."""
    return F.xxhash64(F.lit("digest"), *keys)


def bucket_digests(
    rows: DataFrame,
    keys: list[str],
    buckets: int = 4096,
    hashed: Callable[[list[str]], Column] = _hashed,
    bucket: Callable[[list[str]], Column] | None = None,
) -> DataFrame:
    """Row count and order-free digest of the keys per bucket (at most ``buckets`` rows).

    Sums of hashes, unlike xor, also see keys that occur an even number of times. All 64 bits are summed, without overflow.
    """
    spot = bucket(keys) if bucket else F.pmod(F.xxhash64(*keys), F.lit(buckets))
    return rows.groupBy(spot.cast("bigint").alias("bucket")).agg(
        F.count(F.lit(1)).alias("keys"), F.sum(hashed(keys).cast("decimal(20,0)")).alias("digest")
    )


def drifted_buckets(source: DataFrame, target: DataFrame, keys: list[str], **options) -> DataFrame:
    """Buckets whose key sets differ; equal buckets need no row-level comparison."""
    side = lambda df, p: bucket_digests(df, keys, **options).toDF("bucket", f"{p}_keys", f"{p}_digest")
    both = side(source, "source").join(side(target, "target"), "bucket", "full_outer")
    same = F.col("source_keys").eqNullSafe(F.col("target_keys")) & F.col("source_digest").eqNullSafe(F.col("target_digest"))
    return both.where(~same)


def key_drift(source: DataFrame, target: DataFrame, keys: list[str], only_drifted: int | None = None) -> DataFrame:
    """Keys on which two datasets disagree.

    ``source`` may have ``is_deleted`` (0/1): a key deleted there but live in the
    target is reported as such and also as extra. Key rows are reduced to one per
    key before the join, which reuses that shuffle. With ``only_drifted`` = n,
    digests of n buckets are compared first and only differing buckets are joined;
    this pays off when keys are unique on both sides and few differ.
    """
    gone = F.col("is_deleted") if "is_deleted" in source.columns else F.lit(0)
    src = source.select(*keys, gone.alias("__gone"))
    tgt = target.select(*keys)
    if only_drifted:
        live = src.where("__gone = 0").select(*keys)
        spot = lambda ks: F.pmod(F.xxhash64(*ks), F.lit(only_drifted))
        differing = F.broadcast(drifted_buckets(live, tgt, keys, buckets=only_drifted).select(F.col("bucket").alias("__b")))
        keep = lambda df: df.withColumn("__b", spot(keys)).join(differing, "__b", "left_semi").drop("__b")
        src, tgt = keep(src), keep(tgt)
    s = src.groupBy(*keys).agg(F.min("__gone").alias("__gone"))
    t = tgt.groupBy(*keys).agg(F.lit(True).alias("__there"))
    both = s.join(t, keys, "full_outer")
    there, live = F.col("__there").isNotNull(), F.coalesce(F.col("__gone") == 0, F.lit(False))
    return both.select(
        *keys,
        (live & ~there).alias("missing_in_target"),
        (there & ~live).alias("extra_in_target"),
        (there & F.coalesce(F.col("__gone") == 1, F.lit(False))).alias("deleted_but_live"),
    ).where("missing_in_target OR extra_in_target")


def key_drift_summary(drift: DataFrame) -> DataFrame:
    return drift.agg(
        *[F.count_if(c).alias(c) for c in ("missing_in_target", "extra_in_target", "deleted_but_live")]
    )
