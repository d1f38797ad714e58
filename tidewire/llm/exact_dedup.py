"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one stable id.

Defined results: a null text equals the empty text; very long texts are hashed and compared whole.
A null id never stays while its group has an id. Of repeated rows (same id and text) one stays at
most. Ids may be of any orderable type. An empty table gives no rows. content_groups reads its two
columns only; drop_copies returns every column, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import files_for, free_names, stored


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def content_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    hash_of: Callable[[Column], Column] = md5_128,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The grouping shuffle carries a text once per map task and hash (min and max combine on the
    map side), so a group with a third of all rows costs no more than its number of map tasks.
    Equal minimum and maximum prove that all bytes of a group are the same; groups where they
    differ are hash collisions and are grouped by the text itself.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    pick = F.min if keep == "smallest" else F.max
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body")
    ).withColumn("h", hash_of(F.col("body")))
    files = files_for(docs.count())
    groups = stored(
        rows.groupBy("h")
        .agg(
            F.count(F.lit(1)).alias("group_size"),
            pick("id").alias("keep_id"),
            (F.min("body") != F.max("body")).alias("collides"),
        ),
        "content-groups",
        files,
    )
    # One row per (content, id): repeated rows are told apart by their number, not by a window.
    singles = rows.select("id", "h", F.sha2("body", 256).alias("text_sha256"))
    singles = singles.groupBy("h", "id", "text_sha256").agg(F.count(F.lit(1)).alias("times"))
    bad = groups.filter("collides").select("h")
    if bad.isEmpty():
        joined = singles.join(groups.drop("collides"), "h")
    else:
        # The SHA-256 of the row stands for its text here; the sizes come from grouping the texts.
        split = (
            rows.join(bad, "h", "left_semi")
            .groupBy("h", "body")
            .agg(F.count(F.lit(1)).alias("group_size"), pick("id").alias("keep_id"))
            .select("h", F.sha2("body", 256).alias("text_sha256"), "group_size", "keep_id")
        )
        good = singles.join(groups.filter("not collides").drop("collides"), "h")
        joined = good.unionByName(singles.join(split, ["h", "text_sha256"]))
    return joined.select(
        "id",
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("is_kept"),
        "text_sha256",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("nth"),
    ).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("is_kept") & (F.col("nth") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs that stay, with all their columns; repeated rows are reduced to one.

    Rows are matched to verdicts by id and content hash. Rows that share both are numbered
    first, so that exactly one of them is taken.
    """
    sha, nth = free_names(docs, "sha", "nth")
    verdicts = content_groups(docs, id_col, text_col, keep).filter("kept")
    kept = stored(verdicts.select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha")), "kept-copies", files_for(docs.count()))
    marked = docs.withColumn(sha, F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256))
    staying = marked.join(kept, marked[f"`{id_col}`"].eqNullSafe(kept["id"]) & (marked[f"`{sha}`"] == kept["sha"]), "left_semi")
    # kept holds each (id, content) once. More rows than that are repeats, which one aggregation reduces.
    by = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{sha}`").alias("sha")]
    if staying.groupBy(*by).agg(F.count(F.lit(1)).alias(nth)).filter(F.col(nth) > 1).isEmpty():
        return staying.drop(sha)
    firsts = staying.groupBy(*by).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
    return firsts.select("row.*")
