"""Exact duplicates by recipes of content-defined chunks, with DataFrame functions only.

A text is normalised (the six ASCII white-space characters go) and cut after sentence marks into chunks of 256 to 4096
characters, so that equal texts are cut alike and texts that share passages share chunks. A chunk is known by a 64-bit
fingerprint that is verified by SHA-256: where one fingerprint stands for two digests, the chunks get numbers of their
own. Two texts are equal if their ordered lists of identifiers are; only these lists are shuffled, never the texts.

A group of any size is counted by partial sums before it is shuffled, and its result is joined back, where adaptive
execution splits a hot key.

Null texts count as empty, and all empty texts are one group. A null key counts as larger than any other. Of rows that
repeat with the same key and text, one stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark.llm.common import free_name
from dyadspark.session import stored

SPACE = r"[\x20\x09-\x0D]+"
CHUNK = r"(?s).{256,4096}?(?:(?<=[.!?;:])|\z)|.{1,4096}"


def recipes(df: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(row, key, n_code, text_sha256, prints, digests): what each row's text consists of. Stored.

    ``row`` names a column that numbers the rows; without one they are numbered here.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    plain = F.regexp_replace(whole, SPACE, "")
    cut = df.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
        F.col(key).alias("key"),
        F.length(whole).cast("long").alias("n_code"),
        F.sha2(plain.cast("binary"), 256).alias("text_sha256"),
        F.regexp_extract_all(plain, F.lit(CHUNK), F.lit(0)).alias("chunks"),
    )
    return stored(
        cut.select(
            "row",
            "key",
            "n_code",
            "text_sha256",
            F.transform("chunks", lambda c: F.xxhash64(c)).alias("prints"),
            F.transform("chunks", lambda c: F.unhex(F.sha2(c.cast("binary"), 256))).alias("digests"),
        )
    )


def clashes(made: DataFrame) -> DataFrame:
    """(print, digest, number) of the fingerprints that stand for several chunks; normally none."""
    pairs = made.select(F.explode(F.arrays_zip("prints", "digests")).alias("c")).select(
        F.col("c.prints").alias("print"), F.col("c.digests").alias("digest")
    )
    several = pairs.distinct().groupBy("print").agg(F.array_sort(F.collect_list("digest")).alias("all")).where(F.size("all") > 1)
    return several.select("print", F.posexplode("all").alias("number", "digest"))


def verified(made: DataFrame) -> DataFrame:
    """The recipes with ``numbers``: places and numbers of the chunks whose fingerprint alone does not tell them apart."""
    wrong = clashes(made)
    chunks = made.select("row", F.posexplode(F.arrays_zip("prints", "digests")).alias("place", "c")).select(
        "row", "place", F.col("c.prints").alias("print"), F.col("c.digests").alias("digest")
    )
    found = chunks.join(wrong, ["print", "digest"])
    marks = stored(found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "number"))).alias("numbers")))
    none = F.expr("cast(array() as array<struct<place:int,number:int>>)")
    return made.drop("digests").join(marks, "row", "left").withColumn("numbers", F.coalesce("numbers", none))


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", made: DataFrame | None = None) -> DataFrame:
    """(row, key, keep_id, group_size, kept, text_sha256) for every row.

    Of equal texts the row with the most code points in its original text stays, then the one with the smallest key.
    """
    made = recipes(df, key, text) if made is None else made
    docs = verified(made)
    rank = F.struct((-F.col("n_code")).alias("n"), F.col("key").isNull().alias("no_key"), "key", "row")
    groups = docs.groupBy("prints", "numbers").agg(F.count("*").alias("group_size"), F.min(rank).alias("best"))
    joined = docs.join(groups, ["prints", "numbers"])
    return joined.select(
        "row",
        "key",
        F.col("best.key").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )


def without_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, whole and with their columns."""
    number = free_name(df, "row")
    numbered = stored(df.withColumn(number, F.monotonically_increasing_id()))
    groups = exact_groups(numbered, key, text, recipes(numbered, key, text, number))
    stay = groups.where("kept").select(F.col("row").alias(number))
    return numbered.join(stay, number, "left_semi").drop(number)
