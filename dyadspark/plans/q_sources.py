"""Readers and writers, on files that the query itself writes from the tables to the shared folder."""

from pyspark.sql import functions as F

from dyadspark.operators import profiles as P
from dyadspark.plans import base as B
from dyadspark.plans.registry import query
from dyadspark.session import scratch_path
from dyadspark.sources import files, sinks

ORDER_CSV = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderpriority STRING"


@query("src_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def src_csv(t):
    path = scratch_path(t.spark, "orders-csv")
    sinks.export_csv(t.orders.select(*[c.split()[0] for c in ORDER_CSV.split(", ")]), path)
    return files.read_table(t.spark, path, ORDER_CSV)


@query("src_csv_skip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def src_csv_skip(t):
    path = scratch_path(t.spark, "supplier-csv")
    line = F.concat_ws(",", "s_suppkey", F.concat(F.lit('"'), "s_name", F.lit('"')), "s_acctbal")
    head = F.posexplode(F.array(F.lit("A note, in two lines"), F.lit(""), F.lit("key,name,balance"))).alias("at", "value")
    # a file per country: two preamble lines, the header, the rows
    lines = t.supplier.select("s_nationkey").distinct().select("s_nationkey", head)
    lines = lines.unionByName(t.supplier.select("s_nationkey", F.lit(3).alias("at"), line.alias("value")))
    lines = lines.repartition("s_nationkey").sortWithinPartitions("s_nationkey", "at").select("s_nationkey", "value")
    lines.write.partitionBy("s_nationkey").text(path)
    return files.read_table(t.spark, path, "s_suppkey BIGINT, s_name STRING, s_acctbal DOUBLE", skip_lines=2)


@query(
    "src_semicolon",
    """SELECT p_brand AS state1, CASE WHEN p_type <> 'SMALL' THEN p_type END AS state2, CASE WHEN p_size > 10 THEN p_size END AS "begin",
      CAST(p_size * 11 AS DOUBLE) AS length, CASE WHEN p_size > 40 THEN '"High-tech ' || p_name || '"' END AS characteristics,
      p_name AS source FROM part""",
)
def src_semicolon(t):
    size = F.col("p_size")
    walls = t.part.select(
        F.col("p_brand").alias("Country I"),
        F.when(F.col("p_type") != "SMALL", F.col("p_type")).otherwise("/").alias("Country II"),
        F.when(size > 10, size).alias("Begin Construction"),
        F.concat(size, F.lit("+"), size * 10, F.lit(",0")).alias("Length (km)"),
        F.when(size > 40, F.concat(F.lit('"High-tech '), "p_name", F.lit('"'))).alias("Characteristics"),
        F.col("p_name").alias("Source"),
        *[F.lit(None).cast("string").alias(f"e{i}") for i in range(3)],
    )
    path = scratch_path(t.spark, "walls-csv")
    sinks.export_csv(walls, path, sep=";")
    return files.read_semicolon_walls(t.spark, path)


@query("src_literal", "SELECT c_custkey, level FROM customer JOIN (VALUES ('BUILDING', 1), ('MACHINERY', 2)) v(seg, level) ON seg = c_mktsegment")
def src_literal(t):
    levels = t.spark.createDataFrame([("BUILDING", 1), ("MACHINERY", 2)], "c_mktsegment STRING, level INT")
    return t.customer.join(levels, "c_mktsegment").select("c_custkey", "level")


PROFILE_SQL = "WITH " + B.INFO_SQL + """,
prof AS (SELECT state, region, chr(CAST(97 + state // 26 AS INT)) || chr(CAST(97 + state % 26 AS INT)) AS code, name,
  coalesce(pop, 0) AS pop, CASE WHEN state % 5 <> 4 THEN 1 ELSE 0 END AS has_land FROM info)"""


def profile_docs(t):
    """A profile document per country in the corpus layout, from its customers and suppliers."""
    info = B.info(t).withColumn("pop", F.coalesce("pop", F.lit(0)))
    letter = lambda n: F.char(F.lit(97) + n)
    leaf = lambda c: F.struct(c.alias("text"))
    state = F.col("state")
    border = F.concat(
        F.lit("NATION_"), F.pmod(state + 1, F.lit(25)), F.lit(" "), F.col("pop") + 1, F.lit(" km, NATION_"),
        F.pmod(state + 5, F.lit(25)), F.lit(" (north) "), F.format_number(F.col("pop") * 100 + 1000, 0),
        F.lit(" km, NATION_"), F.pmod(state + 1, F.lit(25)), F.lit(" 1.5 km"),
    )
    land = F.when(F.pmod(state, F.lit(5)) != 4, F.struct(leaf(border).alias("border countries")))
    doc = F.struct(
        F.struct(
            land.alias("Land boundaries"),
            leaf(F.concat(F.lit("flat land of "), "name")).alias("Terrain"),
            F.struct(leaf(F.concat(F.format_number(F.col("pop") * 1000, 0), F.lit(" sq km"))).alias("total")).alias("Area"),
        ).alias("Geography"),
        F.struct(leaf(F.concat("pop", F.lit(" (July 2015 est.)"))).alias("Population")).alias("People and Society"),
        F.struct(
            F.struct(leaf(F.col("name")).alias("conventional short form")).alias("Country name"),
            F.struct(leaf(F.concat(F.lit("Capital of "), "name")).alias("name")).alias("Capital"),
        ).alias("Government"),
        F.struct(
            leaf(
                F.when(F.col("pop") > 55, F.concat("pop", F.lit(".5 billion bbl"))).otherwise(
                    F.concat(F.format_number(F.col("pop") * 1000, 0), F.lit(" million bbl (2015 est.)"))
                )
            ).alias("Crude oil - proved reserves")
        ).alias("Energy"),
    )
    code = F.concat(letter((state / 26).cast("int")), letter(F.pmod(state, F.lit(26))))
    return info.select("state", F.concat(F.lit("region-"), "region").alias("region"), code.alias("code"), F.to_json(doc).alias("doc"))


def profile_corpus(t, regions=None):
    """The documents written one per file below ``region/code`` and read back as a corpus."""
    path = scratch_path(t.spark, "profiles")
    profile_docs(t).select("region", "code", "doc").write.partitionBy("region", "code").text(path)
    return files.read_profiles(t.spark, path, regions, r"/region=([^/]+)/code=([a-z]{2})/[^/]*\.txt$")


@query(
    "src_profiles",
    PROFILE_SQL + """ SELECT 'region-' || region AS region, code, name AS short_name FROM prof WHERE region <> 3""",
)
def src_profiles(t):
    kept = profile_corpus(t, [f"region-{i}" for i in (0, 1, 2, 4)])
    return kept.select("region", "code", P.path_text("doc", "Government", "Country name", "conventional short form").alias("short_name"))


@query("profile_count", "SELECT count(*) AS n FROM nation")
def profile_count(t):
    return profile_corpus(t).agg(F.count(F.lit(1)).alias("n"))


NEIGHBOURS_SQL = PROFILE_SQL + """,
named AS (SELECT state, (state + 1) % 25 AS other, CAST(pop + 1 AS DOUBLE) AS km FROM prof WHERE has_land = 1
  UNION ALL SELECT state, (state + 5) % 25, pop * 100 + 1000 FROM prof WHERE has_land = 1
  UNION ALL SELECT state, (state + 1) % 25, 1.5 FROM prof WHERE has_land = 1
  UNION ALL SELECT state, NULL, NULL FROM prof WHERE has_land = 0)"""


@query(
    "neighbour_lengths",
    NEIGHBOURS_SQL + """ SELECT n.state AS state1, CAST(other AS INT) AS state2, CASE WHEN count(km) = count(*) THEN sum(km) END AS km,
      'flat land of ' || name AS terrain FROM named n JOIN prof USING (state) GROUP BY n.state, other, name""",
)
def neighbour_lengths(t):
    codes = [(rf"^nation_{i}\b", i) for i in range(25)]
    walk = profile_docs(t).select("code", F.col("state").alias("id"))
    return P.neighbour_lengths(profile_corpus(t), walk, codes)


@query(
    "json_rank_quantity",
    PROFILE_SQL + """ SELECT code, CASE WHEN pop > 55 THEN (pop + 0.5) * 1e9 ELSE pop * 1000 * 1e6 END AS quantity FROM prof
      WHERE region IN (0, 1) ORDER BY quantity DESC, code LIMIT 5""",
)
def json_rank_quantity(t):
    docs = profile_corpus(t, ["region-0", "region-1"])
    return P.rank_quantity(docs, "doc", ["Energy", "Crude oil - proved reserves"], ["code"], 5)


@query(
    "json_almanac",
    PROFILE_SQL + """ SELECT code, name, 'Capital of ' || name AS capital, format('{:,}', CAST(pop * 1000 AS BIGINT)) || ' sq km' AS area,
      pop || ' (July 2015 est.)' AS population, CAST(NULL AS VARCHAR) AS languages FROM prof""",
)
def json_almanac(t):
    fields = {
        "name": ["Government", "Country name", "conventional short form"],
        "capital": ["Government", "Capital", "name"],
        "area": ["Geography", "Area", "total"],
        "population": ["People and Society", "Population"],
        "languages": ["People and Society", "Languages"],
    }
    return P.almanac(profile_corpus(t), "doc", ["code"], fields)


@query(
    "json_path",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.z.text') AS missing FROM events""",
)
def json_path(t):
    doc = F.parse_json("props")
    return t.events.select(
        "event_id",
        P.value_at(doc, "k").try_cast("int").alias("k"),
        P.path_text(doc, "z").alias("missing"),
    )


@query(
    "array_ops",
    """SELECT page_id, len(p) AS n, p[1] AS first, p[2] AS second, p[12] AS twelfth FROM (SELECT page_id, string_split(url, '/') AS p FROM pages)""",
)
def array_ops(t):
    parts = t.pages.select("page_id", F.split("url", "/").alias("p"))
    at = lambda i: F.get("p", F.lit(i))
    return parts.select("page_id", F.size("p").cast("bigint").alias("n"), at(0).alias("first"), at(1).alias("second"), at(11).alias("twelfth"))


@query(
    "array_compact",
    """SELECT l_orderkey, l_linenumber, len(list_filter([nullif(l_returnflag, 'N'), nullif(l_linestatus, 'O')], lambda x: x IS NOT NULL)) AS n,
      array_to_string(list_filter([nullif(l_returnflag, 'N'), nullif(l_linestatus, 'O')], lambda x: x IS NOT NULL), '_') AS kept FROM lineitem""",
)
def array_compact(t):
    kept = F.array_compact(F.array(F.nullif("l_returnflag", F.lit("N")), F.nullif("l_linestatus", F.lit("O"))))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.size(kept).cast("bigint").alias("n"), F.array_join(kept, "_").alias("kept"))


@query("html_tables", """SELECT page_id, 0 AS table_no, 1 AS row_no, url AS first, 'page & ' || page_id || ' behind' AS second FROM pages
  UNION ALL SELECT page_id, 0, 0, 'Address', 'Name' FROM pages UNION ALL SELECT page_id, 1, 0, 'inner', NULL FROM pages
  UNION ALL SELECT page_id, 0, 2, 'last', 'cell' FROM pages""")
def html_tables(t):
    from dyadspark.functions.html import html_tables as extract

    table = F.concat(
        F.lit("<table class=t><tr><th>Address<th>Name</tr><tr><td> "), F.replace("url", F.lit("&"), F.lit("&amp;")),
        F.lit(" </td><td><b>page</b> &amp;\n"), "page_id",
        F.lit("<table><tr><td>inner</table> behind</td></tr><tr><td>last<td>cell</table>"),
    )
    rows = extract(t.pages.select("page_id", F.concat(table, "html").alias("html")))
    return rows.select("page_id", "table_no", "row_no", F.get("cells", F.lit(0)).alias("first"), F.get("cells", F.lit(1)).alias("second"))


@query(
    "html_links",
    """SELECT page_id, href, regexp_extract(url, '^(https?://[^/]+)', 1) || href AS url, label AS text, count(*) AS n FROM (SELECT page_id, url,
      unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
      unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label FROM pages) GROUP BY ALL""",
)
def html_links(t):
    from dyadspark.functions.html import html_links as extract

    return extract(t.pages).groupBy("page_id", "href", "url", "text").agg(F.count(F.lit(1)).alias("n"))


@query(
    "html_links_within",
    """SELECT page_id, '/in' AS href, 'in ' || page_id AS text FROM pages UNION ALL SELECT page_id, '/last', 'open' FROM pages""",
)
def html_links_within(t):
    from dyadspark.functions.html import html_links as extract

    body = F.concat(
        F.lit('<br class="menu"><a href="/out">out</a><div class="menu"><img class="x" src="y"><a href="/in">in '),
        "page_id", F.lit('</a><input></div><a href="/out">out</a>'), "html", F.lit('<p class="a menu"><a href="/last">open'),
    )
    return extract(t.pages.select("page_id", "url", body.alias("html")), within="menu").select("page_id", "href", "text")


LIST = """<div id=top class="list wide"><ul><li class=x>a {0}<li class="item_link x"><a href="/b{0}">b</a> {0}<li class=item_link>c {0}<p>c</ul>
  <ol><li>d<li>e<li class=item_link>f {0}</ol></div><ul><li><li><li class=item_link>out</ul>"""


@query(
    "html_selected",
    """SELECT page_id, 'third' AS kind, 0 AS item_no, 'c ' || page_id || ' c' AS text, 'item_link' AS value FROM pages
    UNION ALL SELECT page_id, 'third', 1, 'f ' || page_id, 'item_link' FROM pages
    UNION ALL SELECT page_id, 'link', 0, 'b', '/b' || page_id FROM pages
    UNION ALL SELECT page_id, 'odd', 0, 'a ' || page_id, 'x' FROM pages UNION ALL SELECT page_id, 'odd', 1, 'c ' || page_id || ' c', 'item_link' FROM pages""",
)
def html_selected(t):
    """Texts by selectors: the third items, a link below an item of two classes, every other direct item of a list."""
    from dyadspark.functions.html import html_links as links
    from dyadspark.functions.html import html_texts as texts

    first, *rest = LIST.split("{0}")
    page = F.concat(F.lit(first), *[c for part in rest for c in (F.col("page_id"), F.lit(part))])
    pages = t.pages.select("page_id", "url", page.alias("html"))
    third = texts(pages, "#top .item_link:nth-child(3)", attribute="class").withColumn("kind", F.lit("third"))
    odd = texts(pages, "div.list.wide > ul > li:nth-child(odd)", attribute="class").withColumn("kind", F.lit("odd"))
    link = links(pages, select="li.x.item_link a[href^='/b']").select("page_id", F.col("link_no").alias("item_no"), "text", F.col("href").alias("value"), F.lit("link").alias("kind"))
    return third.unionByName(odd).unionByName(link)


@query(
    "html_spans",
    """SELECT page_id, r AS row_no, c FROM (SELECT page_id, unnest([0, 1, 2, 3]) AS r, unnest(['region|count|count|NULL', 'region|low|high|NULL',
      'north ' || page_id || '|1|2|3', 'north ' || page_id || '|4|NULL|NULL']) AS c FROM pages)""",
)
def html_spans(t):
    """Spanned cells stand in every place they cover, short rows are filled up."""
    from dyadspark.functions.html import html_tables as extract

    table = F.concat(
        F.lit("<table><tr><th rowspan=2>region<th colspan='2'>count<tr><th>low<th>high<tr><td rowspan=0>north "), "page_id",
        F.lit("</td><td>1<td>2<td>3</tr><tr><td>4</table>"),
    )
    rows = extract(t.pages.select("page_id", table.alias("html")))
    return rows.select("page_id", "row_no", F.array_join("cells", "|", "NULL").alias("c"))


@query("sink_parquet", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def sink_parquet(t):
    path = scratch_path(t.spark, "supplier")
    sinks.save_table(t.supplier, path, ["s_nationkey"])
    return sinks.load_table(t.spark, path)


@query("sink_csv", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def sink_csv(t):
    path = scratch_path(t.spark, "customer-csv")
    sinks.export_csv(t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path, quote_all=True)
    return files.read_table(t.spark, path, "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE, c_mktsegment STRING")
