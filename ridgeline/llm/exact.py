"""Exact deduplication by skew-safe combining, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, save, text_or_empty

SALTS = 32


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of docs: its id, the id that stays of its group, the group's size, kept, and the digest of its text.

    Texts are equal when identical after all ASCII white space is deleted. Of a group the row with the most code points in
    its original text stays, of those the smallest id. Three stages each compare whole texts: rows are combined within their
    task (Spark's partial aggregate), then within (digest, salt) so that a text that a third of all rows share is met by many
    tasks, and then the few salt winners of a digest are combined. The last join carries digests only.

    Null texts count as empty; empty texts form a group like any other. Rows that repeat an id and a text are each returned and
    each kept if their id is. A null id loses every tie; where it wins by length, keep_id is null and rows without an id are
    kept. An empty table gives an empty result. Other columns of docs are not read, so their names cannot clash.
    Should two different texts ever agree in both digests, the job fails rather than merging them.
    """
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    base = base.select("id", F.char_length("text").alias("chars"), F.translate("text", SPACES, "").alias("body"))
    base = base.select("*", F.unhex(F.sha2("body", 256)).alias("sha"), F.unhex(F.md5("body")).alias("alt"))
    salted = (
        base.groupBy("sha", "alt", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"), "body", "chars")
        .agg(F.count("*").alias("n"), F.min("id").alias("id"))
        .drop("salt")
    )
    # one exchange by digest serves the three aggregates that follow
    contents = (
        salted.repartition("sha")
        .groupBy("sha", "alt", "body", "chars")
        .agg(F.sum("n").alias("n"), F.min("id").alias("id"))
        .groupBy("sha", "alt", "body")
        .agg(F.sum("n").alias("n"), F.max_by("id", "chars").alias("id"))
    )
    winners = (
        contents.groupBy("sha", "alt")
        .agg(F.count("*").alias("contents"), F.max("n").alias("group_size"), F.max("id").alias("keep_id"))
        .select("sha", "alt", F.when(F.col("contents") > 1, F.raise_error(F.lit("two texts share both digests")).cast("bigint")).otherwise(F.col("group_size")).alias("group_size"), "keep_id")
    )
    winners = save(winners, "exact-winners")
    return (
        base.select("id", "sha", "alt")
        .join(winners, ["sha", "alt"])
        .select(
            F.col("id").alias("doc_id"),
            "keep_id",
            "group_size",
            F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


SQL = r"""
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS kept,
       sha256(body) AS text_sha256
FROM (SELECT doc_id, length(coalesce(text, '')) AS chars,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
      FROM documents)
"""
