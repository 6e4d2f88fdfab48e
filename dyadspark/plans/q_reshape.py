"""Reshaping, text and dates."""

from pyspark.sql import functions as F

from dyadspark.functions import dates as Y
from dyadspark.functions import nulls as N
from dyadspark.functions import text as X
from dyadspark.operators import dyads as D
from dyadspark.operators import reshape as R
from dyadspark.plans import base as B
from dyadspark.plans.q_columns import LEVELS
from dyadspark.plans.registry import query
from dyadspark.session import stored


@query(
    "unpivot",
    """SELECT l_orderkey, l_linenumber, 'l_tax' AS variable, nullif(l_tax, 0) AS value FROM lineitem
      UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem""",
)
def unpivot(t):
    wide = t.lineitem.select("l_orderkey", "l_linenumber", N.na_if("l_tax", [0.0]).alias("l_tax"), "l_discount")
    return R.longer(wide, ["l_orderkey", "l_linenumber"], ["l_tax", "l_discount"], "variable")


def _pivot_cells(agg):
    return ", ".join(f"coalesce({agg} FILTER (o_orderpriority = '{v}'), 0) AS \"{v}\"" for v in LEVELS)


@query("pivot_fill", f"SELECT o_custkey, {_pivot_cells('count(*)')} FROM orders GROUP BY 1")
def pivot_fill(t):
    counts = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return R.wider(counts, ["o_custkey"], "o_orderpriority", "n", LEVELS, fill=0)


@query(
    "split_columns",
    """SELECT p_partkey, split_part(p_name, ' ', 1) AS m1, nullif(split_part(p_name, ' ', 2), '') AS m2,
      nullif(split_part(p_name, ' ', 3), '') AS m3 FROM part""",
)
def split_columns(t):
    return R.split_columns(t.part.select("p_partkey", "p_name"), "p_name", " ", ["m1", "m2", "m3"])


@query("split_rows", "SELECT page_id, unnest(string_split(url, '/')) AS piece FROM pages")
def split_rows(t):
    return R.split_rows(t.pages.select("page_id", F.col("url").alias("piece")), "piece", "/")


@query(
    "unnest_zip",
    """SELECT p_partkey, unnest(CASE WHEN p_size > 5 THEN string_split(p_name, ' ') ELSE [NULL] END) AS name,
      unnest(CASE WHEN p_size > 5 THEN [p_size, p_size * 2] ELSE [NULL] END) AS km FROM part""",
)
def unnest_zip(t):
    arrays = t.part.select(
        "p_partkey",
        F.when(F.col("p_size") > 5, F.split("p_name", " ")).alias("name"),
        F.when(F.col("p_size") > 5, F.array("p_size", F.col("p_size") * 2)).alias("km"),
    )
    return R.unnest_together(arrays, "name", "km")


@query(
    "nest_unnest",
    """SELECT o_orderpriority, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n, count(DISTINCT year(o_orderdate)) OVER
      (PARTITION BY o_orderpriority) AS n_years FROM orders GROUP BY o_orderpriority, year(o_orderdate)""",
)
def nest_unnest(t):
    yearly = t.orders.groupBy("o_orderpriority", F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    nested = R.nest(yearly, ["o_orderpriority"], ["year", "n"]).withColumn("n_years", F.size("data").cast("bigint"))
    return R.unnest(nested, ["o_orderpriority", "n_years"])


MEMBERS_SQL = """
members AS (SELECT l_orderkey AS grp, s_nationkey AS state, sum(l_quantity) AS q FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
  GROUP BY ALL),
shares AS (SELECT grp, state, q / sum(q) OVER (PARTITION BY grp) AS share FROM members)"""


def members(t):
    """Groups (orders) with the countries that hold a part of them and the size of that part."""
    held = (
        t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
        .groupBy(F.col("l_orderkey").alias("grp"), F.col("s_nationkey").alias("state"))
        .agg(F.sum("l_quantity").alias("q"))
    )
    # one entry per country, so at most as many as there are country codes
    listed = held.groupBy("grp").agg(F.collect_list(F.struct("state", "q")).alias("m"), F.sum("q").alias("total"))
    return listed.select("grp", "total", F.inline("m")).select("grp", "state", (F.col("q") / F.col("total")).alias("share"))


@query(
    "pairs_within",
    "WITH " + MEMBERS_SQL + """ SELECT a.state AS state1, b.state AS state2, count(*) AS n_shared FROM members a JOIN members b
      ON a.grp = b.grp AND a.state < b.state GROUP BY ALL""",
)
def pairs_within(t):
    held = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    return D.pairs_in_groups(held.select("l_orderkey", "s_nationkey"), "l_orderkey", "s_nationkey")


@query(
    "pairs_blocked",
    """WITH m AS (SELECT DISTINCT p_brand AS g, p_size AS m FROM part) SELECT a.m AS state1, b.m AS state2, count(*) AS n_shared
      FROM m a JOIN m b ON a.g = b.g AND a.m < b.m GROUP BY ALL""",
)
def pairs_blocked(t):
    """Groups larger than a block, cut into pairs of blocks."""
    return D.pairs_in_groups(t.part, "p_brand", "p_size", block=8)


@query(
    "shared_groups",
    "WITH " + MEMBERS_SQL + """, big AS (SELECT * FROM shares WHERE share >= 0.1)
    SELECT a.state AS state1, b.state AS state2, count(*) AS n_shared FROM big a JOIN big b
      ON a.grp = b.grp AND a.state <> b.state GROUP BY ALL""",
)
def shared_groups(t):
    return D.shared_groups(members(t), "grp", "state", "share", 0.1)


@query(
    "pivot_by_source",
    """SELECT o_custkey, CAST(min(year(o_orderdate)) FILTER (o_orderstatus = 'F') AS INT) AS "F",
      CAST(min(year(o_orderdate)) FILTER (o_orderstatus = 'O') AS INT) AS "O",
      CAST(min(year(o_orderdate)) FILTER (o_orderstatus = 'P') AS INT) AS "P" FROM orders GROUP BY 1""",
)
def pivot_by_source(t):
    dated = t.orders.select("o_custkey", "o_orderstatus", F.year("o_orderdate").alias("year"))
    return R.pivot_by_source(dated, ["o_custkey"], "o_orderstatus", "year", ["F", "O", "P"])


@query(
    "mirror_dyads",
    "WITH " + B.INFO_SQL + "," + B.FLOWS_SQL + """, p AS (SELECT state1, state2, year, n, a.pop AS pop1, b.pop AS pop2 FROM flows
      JOIN info a ON a.state = state1 JOIN info b ON b.state = state2)
    SELECT state1, state2, year, n, pop1, pop2 FROM p UNION ALL SELECT state2, state1, year, n, pop2, pop1 FROM p""",
)
def mirror_dyads(t):
    pairs = D.add_both_ends(B.flows(t).select("state1", "state2", "year", "n"), stored(B.info(t)), "state", {"pop": "pop"})
    return D.mirror(pairs, [("state1", "state2"), ("pop1", "pop2")])


@query(
    "str_concat",
    "SELECT p_partkey, concat_ws('_', p_brand, nullif(p_type, 'SMALL'), p_name) AS joined, p_brand || ', ' || p_type AS label FROM part",
)
def str_concat(t):
    joined = F.concat_ws("_", "p_brand", F.nullif("p_type", F.lit("SMALL")), "p_name")
    return t.part.select("p_partkey", joined.alias("joined"), F.concat("p_brand", F.lit(", "), "p_type").alias("label"))


@query(
    "str_extract",
    """SELECT page_id, nullif(regexp_extract(url, '://([^/]+)/', 1), '') AS host, nullif(regexp_extract(url, 'page=([0-9]+)', 1), '') AS page
      FROM pages""",
)
def str_extract(t):
    # the look-behind form of the same patterns
    host = X.first_of("url", "(?<=://)[^/]+(?=/)", 0)
    return t.pages.select("page_id", host.alias("host"), X.first_of("url", "(?<=page=)[0-9]+", 0).alias("page"))


@query("str_extract_all", "SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]+'), ';') AS numbers FROM documents")
def str_extract_all(t):
    return t.documents.select("doc_id", F.array_join(X.all_of("text", "[0-9]+"), ";").alias("numbers"))


@query(
    "str_replace",
    """SELECT page_id, regexp_replace(url, '[./]', '#') AS first, regexp_replace(url, '[./]', '#', 'g') AS every FROM pages""",
)
def str_replace(t):
    return t.pages.select("page_id", X.replace_first("url", "[./]", "#").alias("first"), F.regexp_replace("url", "[./]", "#").alias("every"))


@query("str_unbracket", "SELECT p_partkey, p_name || ' ' || p_brand AS plain FROM part")
def str_unbracket(t):
    text = F.concat("p_name", F.lit(" ("), "p_type", F.lit(") "), "p_brand", F.lit(" (x)"))
    return t.part.select("p_partkey", X.unbracket(text).alias("plain"))


@query("str_squish", "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\f\\r]+', ' ', 'g'))) AS digest FROM documents")
def str_squish(t):
    return t.documents.select("doc_id", F.md5(X.squish("text")).alias("digest"))


@query("str_sub", "SELECT p_partkey, substr(p_name, 1, length(p_name) - 1) AS cut FROM part")
def str_sub(t):
    return t.part.select("p_partkey", X.drop_end("p_name").alias("cut"))


@query("str_lower", "SELECT c_custkey, lower(c_name) AS name, lower(c_mktsegment) AS segment FROM customer")
def str_lower(t):
    return t.customer.select("c_custkey", F.lower("c_name").alias("name"), F.lower("c_mktsegment").alias("segment"))


@query(
    "parse_number",
    """SELECT o_orderkey, TRY_CAST(replace(format('{:,.2f}', o_totalprice), ',', '') AS DOUBLE) AS price,
      CAST(NULL AS DOUBLE) AS nothing FROM orders""",
)
def parse_number(t):
    return t.orders.select(
        "o_orderkey",
        X.number(F.format_number("o_totalprice", 2)).alias("price"),
        X.number(F.concat(F.lit("n/a "), "o_orderstatus")).alias("nothing"),
    )


@query(
    "parse_neighbours",
    """SELECT p_partkey, n.name AS neighbour, n.km AS km FROM (SELECT p_partkey, unnest(CASE WHEN p_size <= 3 THEN
      [{'name': NULL::VARCHAR, 'km': NULL::DOUBLE}] ELSE [{'name': split_part(p_name, ' ', 1), 'km': CAST(p_size AS DOUBLE)},
      {'name': split_part(p_name, ' ', 2) || ' (' || p_type || ')', 'km': CAST(p_size * 397 AS DOUBLE)},
      {'name': 'Saint ' || p_brand, 'km': p_size / 10}] END) AS n FROM part)""",
)
def parse_neighbours(t):
    from dyadspark.operators.profiles import neighbour_rows

    return neighbour_rows(t.part.select("p_partkey", part_border_text().alias("text")), "text", ["p_partkey"])


def part_border_text():
    """A border text per part row in the corpus notation; the smallest parts have none."""
    word = F.split("p_name", " ")
    size = F.col("p_size")
    return F.when(
        size > 3,
        F.concat(
            word[0], F.lit(" "), size, F.lit(" km, "), word[1], F.lit(" ("), F.col("p_type"), F.lit(") "),
            F.format_number(size * 397, 0), F.lit(" km, Saint "), F.col("p_brand"), F.lit(" "), size / 10, F.lit(" km"),
        ),
    )


@query(
    "parse_additive",
    """SELECT p_partkey, CAST(p_size * 3 AS DOUBLE) AS summed, CAST(p_size + 0.7 AS DOUBLE) AS decimal, CAST(NULL AS DOUBLE) AS bad FROM part""",
)
def parse_additive(t):
    size = F.col("p_size")
    return t.part.select(
        "p_partkey",
        X.additive_length(F.concat(size, F.lit("+"), size * 2)).alias("summed"),
        X.additive_length(F.concat(size, F.lit(",7"))).alias("decimal"),
        X.additive_length(F.concat(size, F.lit("+/"))).alias("bad"),
    )


@query(
    "str_two_names",
    """SELECT p_partkey, p_name AS a, p_type AS b FROM part""",
)
def str_two_names(t):
    a, b = X.two_names(F.concat("p_name", F.lit(" - "), "p_type"))
    return t.part.select("p_partkey", a.alias("a"), b.alias("b"))


@query(
    "fmt_estimate",
    """SELECT l_orderkey, l_linenumber, regexp_replace(regexp_replace(printf('%.3f', l_discount), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')
      || CASE WHEN l_tax < 0.001 THEN '***' WHEN l_tax < 0.01 THEN '**' WHEN l_tax < 0.05 THEN '*' ELSE '' END AS coef,
      '(' || regexp_replace(regexp_replace(printf('%.3f', l_tax), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') || ')' AS se FROM lineitem""",
)
def fmt_estimate(t):
    coef, se = X.estimate_cells("l_discount", "l_tax", "l_tax")
    return t.lineitem.select("l_orderkey", "l_linenumber", coef.alias("coef"), se.alias("se"))


@query("str_na_if", "SELECT c_custkey, CASE WHEN c_mktsegment NOT IN ('BUILDING', '.') THEN c_mktsegment END AS segment FROM customer")
def str_na_if(t):
    return t.customer.select("c_custkey", X.listed_to_null("c_mktsegment", ["BUILDING", "."]).alias("segment"))


@query(
    "p_stars",
    """SELECT l_orderkey, l_linenumber, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*'
      WHEN p < 0.1 THEN '.' WHEN p IS NOT NULL THEN '' END AS mark FROM (SELECT l_orderkey, l_linenumber,
      CASE WHEN l_returnflag <> 'N' THEN l_discount END AS p FROM lineitem)""",
)
def p_stars(t):
    p = F.when(F.col("l_returnflag") != "N", F.col("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", X.stars(p).alias("mark"))


@query(
    "date_parse",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders""",
)
def date_parse(t):
    text = F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return t.orders.select("o_orderkey", Y.parse_date(text, "dd/MM/yyyy").cast("string").alias("day"))


@query(
    "date_year",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, CAST(year(o_orderdate) AS INT) AS from_text FROM orders",
)
def date_year(t):
    text = F.date_format("o_orderdate", "dd/MM/yyyy")
    from_text = X.first_of(text, "/([0-9]{4})", 1).try_cast("int")
    return t.orders.select("o_orderkey", F.year("o_orderdate").alias("year"), from_text.alias("from_text"))


@query("date_serial", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def date_serial(t):
    serial = F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date")).cast("string")
    return t.orders.select("o_orderkey", Y.from_serial(serial).cast("string").alias("day"))


@query(
    "date_bucket5",
    "SELECT CAST(round_even(year(o_orderdate) / 5, 0) * 5 AS INT) AS bucket, count(*) AS n FROM orders GROUP BY 1",
)
def date_bucket5(t):
    return t.orders.groupBy(Y.five_year(F.year("o_orderdate")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "date_rollup",
    """WITH m AS (SELECT o_custkey, year(o_orderdate) AS y, month(o_orderdate) AS mon, sum(CASE WHEN o_orderstatus <> 'P' THEN
      CAST(o_totalprice AS DECIMAL(18,2)) END) AS v FROM orders GROUP BY ALL)
    SELECT o_custkey, CAST(y AS INT) AS year, CAST(CASE WHEN count(v) = count(*) THEN sum(v) END AS DOUBLE) AS total FROM m GROUP BY ALL""",
)
def date_rollup(t):
    value = F.when(F.col("o_orderstatus") != "P", N.money("o_totalprice"))
    monthly = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.sum(value).alias("v"))
    return monthly.groupBy("o_custkey", "year").agg(N.sum_strict("v").cast("double").alias("total"))


@query(
    "date_span",
    """SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'P' THEN 2009 ELSE year(o_orderdate) END AS INT) AS "begin",
      CAST(CASE WHEN o_orderstatus = 'P' THEN 2009 WHEN o_orderstatus = 'F' THEN year(o_orderdate) ELSE year(o_orderdate) + 1 END AS INT) AS "end"
      FROM orders""",
)
def date_span(t):
    start = F.date_format("o_orderdate", "dd/MM/yyyy")
    after = F.concat(F.lit("01/02/"), (F.year("o_orderdate") + 1).cast("string"))
    text = (
        F.when(F.col("o_orderstatus") == "P", "01.02.4008")
        .when(F.col("o_orderstatus") == "F", start)
        .otherwise(F.concat(start, F.lit(" - "), after))
    )
    begin, end = Y.year_span(text, {"4008": 2009})
    return t.orders.select("o_orderkey", begin.alias("begin"), end.alias("end"))


@query(
    "date_sequence",
    """SELECT c_nationkey, CAST(unnest(range(a, z + 1)) AS INT) AS year FROM (SELECT c_nationkey, min(year(o_orderdate)) AS a,
      max(year(o_orderdate)) AS z FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)""",
)
def date_sequence(t):
    span = (
        t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
        .groupBy("c_nationkey")
        .agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("z"))
    )
    return span.select("c_nationkey", F.explode(Y.years(F.col("a"), F.col("z"))).alias("year"))
