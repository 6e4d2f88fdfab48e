"""One query per operator, over its whole table, with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.llm import bpe, chosen_path, chunk_recipes, decontamination, fill_middle, main_text, mixing, periodic_runs, suffix_levels, token_files, toxicity, url_filter, weak_labels
from dyadspark.llm.common import documents, table
from dyadspark.session import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 200-byte strings that occur elsewhere."""
    left = suffix_levels.without_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return left.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query()
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every document within a fifth of their words as edits."""
    found = decontamination.matched(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("matches") > 0).alias("contaminated"),
        F.size("matches").cast("long").alias("n_items"),
        F.array_sort(F.col("matches.item_id")).alias("item_ids"),
        F.array_min("matches.edits").alias("least_edits"),
    )


@query(r"""
    WITH d AS (
      SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
      FROM documents
    ), r AS (
      SELECT doc_id, sha256(plain) AS text_sha256, count(*) OVER (PARTITION BY plain) AS group_size,
             first_value(doc_id) OVER (PARTITION BY plain ORDER BY n DESC, doc_id) AS keep_id
      FROM d
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that are equal but for white space."""
    groups = chunk_recipes.exact_groups(documents(spark, sf_dir, "doc_id", "text"))
    return groups.select(F.col("key").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from three quarters of the labels."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.scored(documents(spark, sf_dir, "doc_id", "text"), labels)
    predicted = F.when(F.col("score") >= 0.3, 1).otherwise(0)
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), "evidence", F.size("spans").alias("n_spans"))


RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


@query()
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every page's url; the last number of a url's path names the document whose labels it has."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(url_filter.host_and_path(F.col("url"))[1], "([0-9]{1,18})[^0-9]*$", 1)
    good = F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)).alias("good")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(good)
    said = pages.select("url", number.try_cast("bigint").alias("doc_id"))
    return url_filter.judged(pages, said.join(labels, "doc_id").select("url", "good"), RULES)


@query()
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directly addressable token files of all documents, written and read back."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    files = token_files.write_tokens(docs, token_files.new_folder(spark), word_vocabulary(), 2)
    return token_files.read_tokens(files).select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))


@query()
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document at similarity 0.8."""
    return chosen_path.joined(documents(spark, sf_dir, "doc_id", "text"))


@query()
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded texts of all documents, as digests."""
    return bpe.digests(bpe.encode(documents(spark, sf_dir, "doc_id", "text"), word_vocabulary()))


@query()
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak label, score and decision for every document."""
    return weak_labels.scored(documents(spark, sf_dir, "doc_id", "text"))


@query()
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = main_text.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


@query()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document; a tenth of the documents gets a period planted first."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")))
    docs = documents(spark, sf_dir, "doc_id", "text").withColumns({"words": words, "g": g}).withColumn("n", F.size("words"))
    docs = docs.withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END"))
    docs = docs.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.expr("array_join(transform(sequence(0, n - 1), i -> words[int(if(i >= a, a + (i - a) % p, i))]), ' ')")
    texts = docs.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))
    found = periodic_runs.found(texts).withColumn("best", periodic_runs.strongest("runs"))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query(r"""
    WITH d AS (
      SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
    ), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, doc_id, text) AS r FROM d
    ), s AS (
      SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS cap,
             ([3, 1, 2])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight,
             ('0x' || substr(sha256('42' || coalesce(':' || source, '')), 1, 8))::UBIGINT::DOUBLE / 4294967296::DOUBLE AS u
      FROM d GROUP BY source
    ), filled AS (
      SELECT (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, cap / weight AS bound
      FROM s
    ), t AS (
      SELECT source, source_size, u, least((SELECT max(level) FROM filled WHERE level <= bound) * weight, cap) AS target FROM s
    ), e AS (
      SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS expected FROM t
    )
    SELECT doc_id, size::BIGINT AS size, source_size, target,
           (size * (floor(r * expected + u) - floor((r - 1) * expected + u)))::BIGINT AS taken
    FROM ranked JOIN e ON ranked.source IS NOT DISTINCT FROM e.source
""")
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document where the sources share 150 % of all words by weights 3, 1, 2."""
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    docs = documents(spark, sf_dir, "doc_id", "source", "text")
    sized = stored(docs.select("doc_id", "source", size.alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("digest")))
    taken = mixing.sampled(sized, order=("doc_id", "digest"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query(r"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
             regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
      FROM documents
    ), drawn AS (
      SELECT *, len(units) AS n,
             ('0x' || substr(h, 1, 8))::UBIGINT % (len(units) + 1) AS c1, ('0x' || substr(h, 9, 8))::UBIGINT % (len(units) + 1) AS c2,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                       OR ('0x' || substr(h, 17, 8))::UBIGINT % 100 >= 50 THEN 'plain'
                  WHEN ('0x' || substr(h, 25, 8))::UBIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
      FROM d
    ), parts AS (
      SELECT *, array_to_string(units[1 : least(c1, c2)::BIGINT], '') AS prefix,
             array_to_string(units[least(c1, c2)::BIGINT + 1 : greatest(c1, c2)::BIGINT], '') AS middle,
             array_to_string(units[greatest(c1, c2)::BIGINT + 1 : n], '') AS suffix
      FROM drawn
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM parts
""")
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle moved to the end, and moved back."""
    back = fill_middle.restored(fill_middle.moved(documents(spark, sf_dir, "doc_id", "text")))
    return back.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("moved").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )
