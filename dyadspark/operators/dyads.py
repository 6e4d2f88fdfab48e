"""Tables whose rows are ordered or unordered pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadspark.functions.nulls import col, flag, row_max, row_min, safe_div, sum0
from dyadspark.operators.ordered import attach_group, first_per_group, join_same
from dyadspark.operators.quantiles import exact_median
from dyadspark.session import stored


def dyad_key(a: str | Column, b: str | Column) -> Column:
    """Undirected pair key ``A_B``; NULL if one end is unknown."""
    return F.concat(row_min(a, b).cast("string"), F.lit("_"), row_max(a, b).cast("string"))


def mirror(df: DataFrame, swaps: Sequence[tuple[str, str]]) -> DataFrame:
    """Each row once as it is and once with the named column pairs exchanged."""
    to = {a: b for a, b in swaps} | {b: a for a, b in swaps}
    return df.unionByName(df.select(*[F.col(to.get(c, c)).alias(c) for c in df.columns]))


def exclude_pairs(df: DataFrame, pairs: DataFrame, a: str = "state1", b: str = "state2") -> DataFrame:
    """Remove listed ordered pairs."""
    return df.join(pairs, [a, b], "left_anti")


def add_partner_value(df: DataFrame, value: str, name: str, a: str = "state1", b: str = "state2") -> DataFrame:
    """The value the reversed pair holds, next to the own one."""
    other = df.select(F.col(b).alias(a), F.col(a).alias(b), F.col(value).alias(name))
    return df.join(other, [a, b], "left")


def add_both_ends(df: DataFrame, table: DataFrame, key: str, attrs: Mapping[str, str]) -> DataFrame:
    """Attributes of a one-row-per-key table put on both ends; ``attrs`` maps attribute to column stem."""
    for n in (1, 2):
        end = table.select(F.col(key).alias(f"state{n}"), *[F.col(c).alias(f"{stem}{n}") for c, stem in attrs.items()])
        df = df.join(end, f"state{n}", "left")
    return df


def trade_panel(flows: DataFrame, names: DataFrame) -> DataFrame:
    """Pair-year exports and imports seen from both ends, with totals, shares and logarithms.

    ``flows`` (state1, state2, year, flow) is reduced to pairs x years before anything else happens.
    """
    undirected = stored(
        flows.where(F.col("state1") != F.col("state2"))
        .groupBy("year", F.least("state1", "state2").alias("a"), F.greatest("state1", "state2").alias("b"))
        .agg(
            F.max(F.when(F.col("state1") < F.col("state2"), F.col("flow"))).alias("export"),
            F.max(F.when(F.col("state1") > F.col("state2"), F.col("flow"))).alias("import"),
        )
        .withColumnsRenamed({"a": "state1", "b": "state2"})
    )
    directed = mirror(undirected, [("state1", "state2"), ("export", "import")])
    totals = attach_group(directed, ["year", "state1"], total_export=sum0("export"), total_import=sum0("import"))
    named = add_both_ends(totals, names, "state", {"name": "name", "region": "region"})
    amount = {c: F.col(c).cast("double") for c in ("export", "import", "total_export", "total_import")}
    return named.select(
        "year",
        F.col("name1").alias("state1"),
        F.col("name2").alias("state2"),
        dyad_key("name1", "name2").alias("dyad"),
        "region1",
        "region2",
        flag(F.col("region1") == F.col("region2")).alias("same_region"),
        *[c.alias(n) for n, c in amount.items()],
        F.round(safe_div(amount["export"], amount["total_export"]) * 100, 4).alias("share_export"),
        F.round(safe_div(amount["import"], amount["total_import"]) * 100, 4).alias("share_import"),
        F.round(F.log1p(amount["export"]), 4).alias("export_log"),
        F.round(F.log1p(amount["import"]), 4).alias("import_log"),
    )


def in_out_flows(flows: DataFrame, people: DataFrame, flow: str = "flow") -> DataFrame:
    """Incoming and outgoing flow per directed pair with country totals, per-head rates and logarithms.

    ``flows`` runs from ``origin`` to ``host``; ``people`` is (state, pop). Row (state1, state2) holds what state1
    receives from state2 and what it sends there.
    """
    pair = stored(flows.groupBy("host", "origin").agg(F.sum(flow).alias("v")))
    with_total = attach_group(pair, ["host"], agg=sum0("v")).withColumns({c: F.col(c).cast("double") for c in ("v", "agg")})
    incoming = with_total.selectExpr("host AS state1", "origin AS state2", "v AS incoming", "agg AS incoming_agg")
    outgoing = with_total.selectExpr("origin AS state1", "host AS state2", "v AS outgoing", "agg AS outgoing_agg")
    both = incoming.join(outgoing, ["state1", "state2"], "left")
    both = add_both_ends(both, people, "state", {"pop": "pop"})
    heads = {"incoming": "pop1", "incoming_agg": "pop1", "outgoing": "pop2", "outgoing_agg": "pop2"}
    rate = {f"{c}_pc": safe_div(F.col(c), F.col(p)) for c, p in heads.items()}
    logs = {f"{c}_log": F.log1p(c) for c in [*heads, *rate]}
    return both.withColumns(rate).withColumns(logs)


def flag_latest(pairs: DataFrame, latest: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """0/1 whether a pair occurs in ``latest``, keeping that table's columns."""
    return pairs.join(latest.withColumn(name, F.lit(1)), list(keys), "left").fillna(0, [name])


def settled_pairs(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Last record per pair of known ends, then mirrored."""
    known = df.where(F.col("state1").isNotNull() & F.col("state2").isNotNull())
    return mirror(first_per_group(known, keys, order), [("state1", "state2")])


BLOCK = 512  # members of a block


def pairs_in_groups(members: DataFrame, group: str, member: str, block: int = BLOCK) -> DataFrame:
    """How many groups each unordered pair of members shares; groups may be of any size.

    Groups of at most ``block`` members are put together as sets; equal sets are counted first, and pairs are formed
    once per distinct set. A larger group is cut into blocks by a hash of the member, and every pair of blocks is a task
    of its own, so no array and no task ever holds more than the members of two blocks (about ``block`` each).
    """
    held = stored(members.select(F.col(group).alias("_g"), F.col(member).alias("_m")).where(F.col("_m").isNotNull()).distinct())
    sizes = held.groupBy("_g").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > 1)
    large = stored(sizes.where(F.col("_size") > block))
    known = F.col("_g").eqNullSafe(F.col("_l"))
    small = held.join(large.select(F.col("_g").alias("_l")), known, "left_anti")
    sets = (
        small.groupBy("_g")
        .agg(F.array_sort(F.collect_list("_m")).alias("_set"))
        .where(F.size("_set") > 1)
        .groupBy("_set")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    first = sets.select("_set", "_n", F.posexplode("_set").alias("_i", "state1"))
    rest = F.slice("_set", F.col("_i") + 2, F.size("_set"))
    pairs = first.select("_n", "state1", F.explode(rest).alias("state2"))
    if not large.isEmpty():
        pairs = pairs.unionByName(_block_pairs(held, large, block))
    return pairs.groupBy("state1", "state2").agg(F.sum("_n").alias("n_shared"))


def _block_pairs(held: DataFrame, large: DataFrame, block: int) -> DataFrame:
    """Pairs (state1 < state2) within large groups: each member goes to all pairs of blocks that hold its own."""
    blocks = F.ceil(F.col("_size") / block).cast("int")
    placed = held.join(large.select(F.col("_g").alias("_l"), blocks.alias("_blocks")), F.col("_g").eqNullSafe(F.col("_l")))
    placed = placed.withColumn("_own", F.pmod(F.xxhash64("_m"), F.col("_blocks")).cast("int"))
    copies = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        "_g", "_m", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), (F.col("_own") > F.col("_other")).alias("_second")
    )
    met = copies.groupBy("_g", "_i", "_j").agg(
        F.collect_list(F.when(~F.col("_second"), F.col("_m"))).alias("_a"), F.collect_list(F.when(F.col("_second"), F.col("_m"))).alias("_b")
    )
    # Blocks that meet themselves pair their members up once; others pair all of one with all of the other.
    other = F.when(F.col("_i") == F.col("_j"), F.col("_a")).otherwise(F.col("_b"))
    pairs = met.withColumn("_b", other).select("_i", "_j", F.explode("_a").alias("_x"), "_b").select("_i", "_j", "_x", F.explode("_b").alias("_y"))
    once = (F.col("_i") != F.col("_j")) | (F.col("_x") < F.col("_y"))
    return pairs.where(once).select(F.lit(1).cast("bigint").alias("_n"), F.least("_x", "_y").alias("state1"), F.greatest("_x", "_y").alias("state2"))


def shared_groups(members: DataFrame, group: str, member: str, share: str, minimum: float) -> DataFrame:
    """Directed pairs with the number of groups that live on both sides, counting shares above a minimum."""
    counted = pairs_in_groups(members.where(F.col(share) >= minimum), group, member)
    return mirror(counted, [("state1", "state2")])


def neighbour_profile(df: DataFrame, label: str, values: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Mean and median of the partner's value and of the absolute gap, by own label, with the valid pairs.

    ``values`` maps a name to its (own column, partner's column). All statistics are taken in one long pass.
    """
    cells = {}
    for name, (own, other) in values.items():
        cells |= {name: F.col(other), f"gap_{name}": F.abs(F.col(own) - F.col(other))}
    long = df.select(label, *[c.cast("double").alias(n) for n, c in cells.items()]).unpivot(
        [label], list(cells), "_name", "_value"
    )
    stats = exact_median(long, [label, "_name"], "_value", mean=F.avg("_v"), obs=F.count("_v"))

    def cell(n: str, stat: str) -> Column:
        return F.max(F.when(F.col("_name") == n, F.col(stat)))

    wide = stats.groupBy(label).agg(
        *[cell(n, s).alias(f"{s}_{n}") for n in cells for s in ("mean", "median")],
        *[cell(f"gap_{n}", "obs").alias(f"n_{n}") for n in values],
    )
    return join_same(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), wide, [label])


def direction_share(df: DataFrame, label: str, values: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Percent of complete pairs whose own value is at least the partner's, by label."""
    used = [c for pair in values.values() for c in pair]
    return (
        df.dropna(subset=used)
        .groupBy(label)
        .agg(
            *[
                (F.sum(flag(F.col(a) >= F.col(b))) / F.count(F.lit(1)) * 100).alias(f"share_{n}")
                for n, (a, b) in values.items()
            ]
        )
    )


def unequal_pairs(df: DataFrame, own: str, other: str, k: int) -> DataFrame:
    """The ``k`` unordered pairs with the widest gap."""
    one = first_per_group(
        df.withColumn("dyad", dyad_key("state1", "state2")), ["dyad"], [F.asc("state1"), F.asc("state2")]
    )
    gap = one.dropna(subset=[own, other]).withColumn("gap", F.abs(F.col(own) - F.col(other)))
    return gap.select("dyad", "gap").orderBy(F.desc("gap"), "dyad").limit(k)


def region_subset(df: DataFrame, typology: DataFrame, regions: Sequence, order: Sequence[Column]) -> DataFrame:
    """Pairs with at least one end in the regions, their label attached, one row per ordered pair."""
    inside = df.where(F.col("region1").isin(list(regions)) | F.col("region2").isin(list(regions)))
    return first_per_group(inside.join(typology, ["state1", "state2"], "left"), ["state1", "state2"], order)


def relation_status(own: str | Column, other: str | Column, labels: tuple[str, str, str]) -> Column:
    """(neither, own only, other only) from two 0/1 flags; anything else is NULL."""
    a, b = col(own), col(other)
    return (
        F.when((a == 0) & (b == 0), labels[0])
        .when((a == 1) & (b == 0), labels[1])
        .when((a == 0) & (b == 1), labels[2])
    )
