"""The directed panel of neighbouring countries, put together from its sources.

Every source is a DataFrame (landed files); the result has one row per ordered pair. All joins are left joins from
the pair list, attribute tables are reduced to one row per key first, and nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadspark.functions.nulls import flag, in_list, na_if, safe_div, sum0
from dyadspark.operators.aggregates import n_rows
from dyadspark.operators.codes import lookup_first, patch_keyed, recode
from dyadspark.operators.columns import across
from dyadspark.operators.dyads import add_both_ends, add_partner_value, dyad_key, exclude_pairs, flag_latest, mirror, relation_status
from dyadspark.operators.joins import complete_panel
from dyadspark.operators.ordered import attach_group, dense_ids, first_per_group, latest_if
from dyadspark.operators.panel import modal_family

# Code corrections, pair corrections, families of denominations. Column names follow the sources' schemas.
NUMBER_CODES = {345: "SRB", 347: "XKX"}
HOSTS_LEFT_OUT = [667]  # not counted as host of refugees
UNNAMED_NEIGHBOURS = {"BHR": "SAU", "CYP": "TUR", "SGP": "MYS"}  # profiles that name no neighbour
REGIME_CODES = {"KOS": "XKX", "GMY": "DEU"}
ADDED_PAIRS = [("NGA", "TCD"), ("TCD", "NGA")]
WRONG_PAIRS = [("ARE", "QAT"), ("QAT", "ARE"), ("MMR", "PAK"), ("PAK", "MMR")]
OTHER_FAMILIES = ["bud", "hindgen", "jud", "nonrelig", "syncgen"]
FAMILIES = {
    "chrst": ["chrstprot", "chrstcat", "chrstorth", "chrstang", "chrstothr", "chrstgen"],
    "jud": ["judorth", "jdcons", "judref", "judothr", "judgen"],
    "islm": ["islmsun", "islmshi", "islmibd", "islmnat", "islmalw", "islmahm", "islmothr", "islmgen"],
    "bud": ["budmah", "budthr", "budothr", "budgen"],
}
COLONY = ["state1_colonizer", "state2_colonizer", "colony", "comlang_off"]
COLONY_PATCHES = {
    ("ALB", "XKX"): (0, 0, 0, 1),
    ("MKD", "XKX"): (0, 0, 0, 0),
    ("MNE", "XKX"): (0, 0, 0, 0),
    ("SRB", "XKX"): (1, 0, 1, 1),
    ("XKX", "ALB"): (0, 0, 0, 1),
    ("XKX", "MKD"): (0, 0, 0, 0),
    ("XKX", "MNE"): (0, 0, 0, 0),
    ("XKX", "SRB"): (0, 1, 1, 1),
}
PLACES = {"XKX": ("Europe", "Southern Europe")}
PAIR = ["state1", "state2"]


@dataclass
class Sources:
    """Input tables and the columns each must have."""

    contiguity: DataFrame  # state1no, state2no, year, conttype
    number_codes: DataFrame  # number, code
    regime_codes: DataFrame  # scode, code
    agreements: DataFrame  # state1, state2, settle
    indicators: DataFrame  # code, pop, gdp, military_pers, military_expenditure_perc_gdp, gdp_2014
    trade: DataFrame  # ccode1, ccode2, year, flow1, flow2
    regimes: DataFrame  # scode, year, polity2
    religions: DataFrame  # state, year, one column per denomination
    disputes: DataFrame  # statea, stateb, year, strtyr, outcome
    incidents: DataFrame  # code, iyear, nkill, nwound
    refugees: DataFrame  # asylum_ccode, origin_ccode, year, ylinpol
    gravity: DataFrame  # iso3_o, iso3_d, year, heg_o, heg_d, col_dep_ever, comlang_off, comrelig
    neighbours: DataFrame  # state1, state2, km, terrain (profiles.neighbour_lengths with UNNAMED_NEIGHBOURS)
    terrain: DataFrame  # statea, stateb, year and any terrain measures


@dataclass
class Years:
    pairs: int = 2016
    trade: int = 2014
    regime: int = 2017
    religion: int = 2010
    incidents: int = 2017
    refugees: int = 2015
    gravity: int = 2019
    terrain: int = 2001
    disputes_since: int = 2000


def coded(df: DataFrame, codes: DataFrame, first: str, second: str) -> DataFrame:
    """Numeric ids of both ends as ``state1`` and ``state2``."""
    for end, c in zip(PAIR, (first, second)):
        df = recode(df, c, codes, "number", "code", end, NUMBER_CODES).drop(c)
    return df


def both_ends(df: DataFrame, table: DataFrame, key: str, attrs: list[str], order: list[Column]) -> DataFrame:
    """First matching row's attributes as ``state1_x`` and ``state2_x``."""
    for end in PAIR:
        df = lookup_first(df, end, table, key, {a: f"{end}_{a}" for a in attrs}, order)
    return df


def base_pairs(s: Sources, year: int) -> DataFrame:
    land = s.contiguity.where((F.col("year") == year) & (F.col("conttype") == 1)).select("state1no", "state2no")
    spark = land.sparkSession
    pairs = coded(land, s.number_codes, "state1no", "state2no").unionByName(spark.createDataFrame(ADDED_PAIRS, "state1 STRING, state2 STRING"))
    return exclude_pairs(pairs, spark.createDataFrame(WRONG_PAIRS, "state1 STRING, state2 STRING"))


def add_indicators(df: DataFrame, s: Sources) -> DataFrame:
    levels = ["pop", "gdp", "military_pers", "military_expenditure_perc_gdp"]
    df = both_ends(df, s.indicators, "code", [*levels, "gdp_2014"], [F.asc("pop"), F.asc("gdp")])
    for end in PAIR:
        per_head = safe_div(F.col(f"{end}_military_pers"), F.col(f"{end}_pop"))
        df = df.withColumns({f"{end}_military_pers_pc": per_head, f"{end}_military_pers_p1000": per_head * 1000})
    logged = [f"{end}_{c}" for end in PAIR for c in [*levels, "military_pers_pc", "military_pers_p1000"]]
    df = across(df, logged, {"log": F.log1p})
    millions = {f"{end}_pop_in_million": F.col(f"{end}_pop") / 1000000 for end in PAIR}
    return df.withColumns({"ratio_gdp": safe_div("state1_gdp", "state2_gdp"), **millions})


def trade_records(s: Sources, year: int) -> DataFrame:
    """Both directions of the recorded flows with shares of the reporting country's known total."""
    flows = coded(s.trade.where(F.col("year") == year).select("ccode1", "ccode2", "flow1", "flow2"), s.number_codes, "ccode1", "ccode2")
    flows = flows.select(*PAIR, na_if("flow1", [-9]).alias("import"), na_if("flow2", [-9]).alias("export"))
    total = attach_group(flows, ["state1"], total_import=sum0("import"), total_export=sum0("export"))
    shares = {f"share_{c}": safe_div(F.col(c), F.col(f"total_{c}")) * 100 for c in ("import", "export")}
    swaps = [("state1", "state2"), ("export", "import"), ("share_export", "share_import")]
    return across(mirror(total.withColumns(shares), swaps), ["export", "import"], {"log": F.log1p})


def add_trade(df: DataFrame, s: Sources, year: int) -> DataFrame:
    df = df.join(trade_records(s, year), PAIR, "left")
    dependence = safe_div(F.col("import") + F.col("export"), F.col("state1_gdp_2014"))
    return df.withColumn("economic_dependence", dependence).withColumn("economic_dependence_log", F.log1p("economic_dependence"))


def add_regimes(df: DataFrame, s: Sources, year: int) -> DataFrame:
    scores = recode(s.regimes.where(F.col("year") == year), "scode", s.regime_codes, "scode", "code", "_code", REGIME_CODES)
    df = both_ends(df, scores.select("_code", F.col("polity2").alias("polity")), "_code", ["polity"], [F.asc("polity")])
    diff = F.col("state1_polity") - F.col("state2_polity")
    return df.withColumns({"diff_pol": diff, "absdiff_pol": F.abs(diff)})


def add_religion(df: DataFrame, s: Sources, year: int) -> DataFrame:
    wide = recode(s.religions.where(F.col("year") == year), "state", s.number_codes, "number", "code", "_code", NUMBER_CODES)
    cols = [c for c in s.religions.columns if c not in ("state", "year")]
    members = {m: family for family, names in FAMILIES.items() for m in names}
    main = modal_family(wide.where(F.col("_code").isNotNull()).select("_code", *cols), "_code", cols, members)
    df = both_ends(df, main.withColumnRenamed("family", "relig"), "_code", ["relig"], [F.asc("relig")])
    for end in PAIR:
        df = patch_keyed(df, [{end: "SSD", f"{end}_relig": "chrst"}], [end])
        relig = F.col(f"{end}_relig")
        df = df.withColumns({f"{end}_relig_shrt": F.when(in_list(relig, OTHER_FAMILIES), "other").otherwise(relig), f"{end}_muslim": flag(relig == "islm")})
    differ = {n: flag(F.col(f"state1_{c}") != F.col(f"state2_{c}")) for n, c in (("diff_relig", "relig"), ("diff_relig_shrt", "relig_shrt"))}
    return df.withColumns(differ)


def add_disputes(df: DataFrame, s: Sources, since: int) -> DataFrame:
    recent = latest_if(s.disputes, ["statea", "stateb"], [F.desc("year"), F.desc("strtyr"), F.asc("outcome")], F.col("strtyr") >= since)
    recent = coded(recent, s.number_codes, "statea", "stateb").select(*PAIR, F.col("year").alias("disp_year"), F.col("outcome").alias("disp_outcome"))
    return flag_latest(df, recent, PAIR, f"disp_from_{since}")


def add_incidents(df: DataFrame, s: Sources, year: int) -> DataFrame:
    counts = s.incidents.groupBy("code", "iyear").agg(n_rows().alias("nterror"), sum0("nkill").alias("death_toll"))
    panel = complete_panel(counts, ["code"], "iyear", {"nterror": 0, "death_toll": 0}).where(F.col("iyear") == year)
    df = both_ends(df, panel, "code", ["nterror", "death_toll"], [F.asc("iyear")])
    cols = [f"{end}_{c}" for c in ("nterror", "death_toll") for end in PAIR]
    return across(df.fillna(0, cols), cols, {"log": F.log1p})


def add_refugees(df: DataFrame, s: Sources, year: int) -> DataFrame:
    hosts = s.refugees.where((F.col("year") == year) & ~F.col("asylum_ccode").isin(HOSTS_LEFT_OUT))
    moves = coded(hosts.select("asylum_ccode", "origin_ccode", "ylinpol"), s.number_codes, "asylum_ccode", "origin_ccode")
    totals = attach_group(moves, ["state1"], agg=sum0("ylinpol"))
    for way, ends, people in (("incoming", ("state1", "state2"), "state1_pop"), ("outgoing", ("state2", "state1"), "state2_pop")):
        stem = f"refugees_{way}"
        named = totals.select(
            F.col("state1").alias(ends[0]), F.col("state2").alias(ends[1]), F.col("ylinpol").alias(stem), F.col("agg").alias(f"{stem}_agg")
        )
        df = df.join(named, PAIR, "left")
        df = df.withColumns({f"{c}_pc": safe_div(F.col(c), F.col(people)) for c in (stem, f"{stem}_agg")})
        df = across(df, [stem, f"{stem}_agg", f"{stem}_pc", f"{stem}_agg_pc"], {"log": F.log1p})
    return df


def add_colonial(df: DataFrame, s: Sources, year: int) -> DataFrame:
    ties = s.gravity.where((F.col("iso3_o") != F.col("iso3_d")) & (F.col("year") == year)).select(
        *[F.col(c).alias(n) for c, n in zip(["iso3_o", "iso3_d", "heg_o", "heg_d", "col_dep_ever", "comlang_off", "comrelig"], [*PAIR, *COLONY, "relig_prox"])]
    )
    patches = [dict(zip([*PAIR, *COLONY], [*pair, *values])) for pair, values in COLONY_PATCHES.items()]
    df = patch_keyed(df.join(ties, PAIR, "left"), patches, PAIR)
    return df.withColumn("colonial_status", relation_status(COLONY[0], COLONY[1], ("no colony", "colonizer", "colonized")))


def add_terrain(df: DataFrame, s: Sources, year: int) -> DataFrame:
    """Border lengths, pair name and number, and terrain measures of the undirected pair."""
    lengths = s.neighbours.where(F.col("state2").isNotNull()).select(*PAIR, F.col("km").alias("blength"))
    texts = first_per_group(s.neighbours.select("state1", "terrain"), ["state1"], [F.asc_nulls_last("terrain")])
    df = df.join(lengths, PAIR, "left").join(texts, "state1", "left")
    df = dense_ids(df.withColumn("dyadName", dyad_key("state1", "state2")), "dyadName", "dyadID")
    measured = coded(s.terrain.where(F.col("year") == year).drop("year"), s.number_codes, "statea", "stateb")
    named = measured.withColumn("dyadName", dyad_key("state1", "state2")).drop(*PAIR)
    one = first_per_group(named, ["dyadName"], [F.asc(c) for c in named.columns if c != "dyadName"])
    return df.join(one, "dyadName", "left")


def border_panel(s: Sources, years: Years | None = None) -> DataFrame:
    """All steps in order."""
    y = years or Years()
    df = base_pairs(s, y.pairs).join(s.agreements, PAIR, "left")
    df = add_trade(add_indicators(df, s), s, y.trade)
    df = add_religion(add_regimes(df, s, y.regime), s, y.religion)
    df = add_incidents(add_disputes(df, s, y.disputes_since), s, y.incidents)
    df = add_colonial(add_refugees(df, s, y.refugees), s, y.gravity)
    return add_terrain(df, s, y.terrain)


def typed_panel(panel: DataFrame, typology: DataFrame, places: DataFrame) -> DataFrame:
    """The pairs that have a type, with their panel columns, continent and region of both ends, and the partner's type.

    ``typology`` is (state1, state2, typology, ...) and may list a pair several times; ``places`` is (code, continent,
    region).
    """
    spark = panel.sparkSession
    wrong = spark.createDataFrame(WRONG_PAIRS[:2], "state1 STRING, state2 STRING")
    known = exclude_pairs(typology.where(F.col("typology").isNotNull()), wrong)
    one = first_per_group(known, PAIR, [F.asc(c) for c in known.columns if c not in PAIR]).select(*PAIR, "typology")
    fixed = spark.createDataFrame([(k, *v) for k, v in PLACES.items()], "code STRING, continent STRING, region STRING")
    located = places.where(~F.col("code").isin(list(PLACES))).select("code", "continent", "region").unionByName(fixed)
    joined = add_both_ends(one.join(panel, PAIR, "left"), located, "code", {"continent": "continent", "region": "region"})
    return add_partner_value(joined, "typology", "state2_typology").withColumnRenamed("typology", "state1_typology")
