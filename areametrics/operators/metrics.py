"""Biodiversity metrics per area.

Every function takes the joined occurrences and column names, so one function serves parks,
grid cells and neighbourhoods. None of them shuffles rows grouped by area: rows are first
reduced to distinct tuples or counts under wider keys, so an area holding a third of all
occurrences is spread over many tasks.

Only keys and counts go through the wide aggregations. Text and geometry inside ``min`` or
``any_value`` would make Spark sort the input instead of hashing it, so such columns are
grouping keys first and are picked from the few distinct tuples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areametrics.operators.joins import sized_join
from areametrics.sources.shared import stored

# Ranks counted per area, with the result column of each.
RANKS = {
    "kingdom": "kingdom_richness",
    "family": "family_richness",
    "genus": "genus_richness",
    "species": "species_richness",
}

_AREA = "_area"


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def keep_keyed(df: DataFrame, key: str) -> DataFrame:
    """Rows whose group key is not null."""
    return df.where(_q(key).isNotNull())


def any_per_key(df: DataFrame, key: str, value: str, name: str | None = None) -> DataFrame:
    """One non-null value per key (null when a key has none), for values of any type."""
    pairs = df.select(key, value).distinct()
    return pairs.groupBy(key).agg(F.any_value(_q(value), True).alias(name or value))


def _value_counts(df: DataFrame, key: str, values: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Row count per (``_AREA``, value) for several columns at once, and a test per column.

    Grouping sets read the rows once and shuffle once. Each row of the result belongs to one
    column of ``values``; its test says which. The shuffle key holds the value, so a large area
    is spread, and taxa are already merged on the map side.
    """
    names = [_AREA, *values]
    rows = df.select(_q(key).alias(_AREA), *[_q(v) for v in values])
    grouped = rows.groupingSets([[F.col(_AREA), _q(v)] for v in values], *[_q(n) for n in names])
    counts = grouped.agg(
        F.count("*").alias("_n"), F.grouping_id(*[_q(n) for n in names]).alias("_set")
    )
    # The id of a set has a 0 bit for each column it groups by; the first column is the highest.
    ones = 2 ** len(values) - 1
    tests = {
        v: F.col("_set") == ones - 2 ** (len(values) - 1 - i) for i, v in enumerate(values)
    }
    return counts, tests


def _area_summary(
    df: DataFrame, key: str, id_col: str | None, geom_col: str | None, observation: str,
    index: bool,
) -> DataFrame:
    rows = keep_keyed(df, key)
    other_id = id_col if id_col not in (None, key) else None
    in_sets = other_id and isinstance(df.schema[other_id].dataType, T.NumericType)
    values = [observation, *RANKS, *([other_id] if in_sets else [])]
    counts, tests = _value_counts(rows, key, values)

    def distinct(column: str) -> Column:
        return F.count(F.when(tests[column], _q(column)))

    wanted = [distinct(observation).alias("observation")]
    wanted += [distinct(r).alias(n) for r, n in RANKS.items()]
    if in_sets:
        wanted.append(F.min(F.when(tests[other_id], _q(other_id))).alias(other_id))
    if index:
        n = F.when(tests["species"], F.col("_n").cast("double"))
        wanted += [
            F.count(n).alias("_kinds"), F.sum(n).alias("_rows"), F.sum(n * F.log(n)).alias("_nlogn")
        ]
    out = counts.groupBy(_AREA).agg(*wanted).withColumnRenamed(_AREA, key)
    if index:
        out = out.withColumn("shannon_index", _entropy("_kinds", "_rows", "_nlogn")).drop(
            "_kinds", "_rows", "_nlogn"
        )
    if other_id and not in_sets:
        ids = rows.select(key, other_id).distinct().groupBy(key).agg(F.min(_q(other_id)).alias(other_id))
        out = out.join(ids, key)
    if geom_col:
        out = out.join(any_per_key(rows, key, geom_col), key)
    return out


def taxa_richness(
    df: DataFrame,
    group_by: str,
    id_col: str | None = None,
    geom_col: str | None = None,
    observation: str = "gbifID",
) -> DataFrame:
    """Distinct occurrences and distinct taxa at four ranks, per non-null ``group_by``.

    ``id_col`` gives the smallest id of the group, ``geom_col`` one of its geometries.
    """
    return _area_summary(df, group_by, id_col, geom_col, observation, index=False)


def by_richness(df: DataFrame, key: str) -> DataFrame:
    """Richest first; equal richness in key order."""
    return df.orderBy(F.desc("species_richness"), key)


def park_richness(df: DataFrame, geom: bool = False) -> DataFrame:
    """Richness per park name."""
    return taxa_richness(df, "park_name", "park_id", "park_geom" if geom else None)


def species_counts(df: DataFrame, key: str = "park_name") -> DataFrame:
    """Rows per (area, species). A null species is a group of its own."""
    return keep_keyed(df, key).groupBy(key, "species").agg(F.count("*").alias("species_count"))


def totals(counts: DataFrame, key: str = "park_name") -> DataFrame:
    """Sum of species counts per area."""
    return counts.groupBy(key).agg(F.sum("species_count").alias("total_count"))


def species_proportions(df: DataFrame, key: str = "park_name") -> DataFrame:
    """Share ``p`` of each species in its area's rows."""
    counts = species_counts(df, key)
    p = F.col("species_count").cast("double") / F.col("total_count").cast("double")
    return counts.join(totals(counts, key), key).withColumn("p", p)


def _entropy(kinds: str, rows: str, nlogn: str) -> Column:
    """H from N = ``rows`` and sum(n ln n); exactly 0 for one species."""
    return F.when(F.col(kinds) == 1, F.lit(0.0)).otherwise(
        F.log(rows) - F.col(nlogn) / F.col(rows)
    )


def shannon_index(df: DataFrame, key: str = "park_name") -> DataFrame:
    """H = -sum(p ln p) per area, null species counted as one species.

    With n rows per species and N in all, that is ln N - sum(n ln n) / N: sums that combine
    before the shuffle, with no join to the totals and no second pass.
    """
    n = F.col("species_count").cast("double")
    sums = species_counts(df, key).groupBy(key).agg(
        F.count("*").alias("_kinds"), F.sum(n).alias("_rows"), F.sum(n * F.log(n)).alias("_nlogn")
    )
    return sums.select(key, _entropy("_kinds", "_rows", "_nlogn").alias("shannon_index"))


def with_shannon(richness: DataFrame, shannon: DataFrame, key: str = "park_name") -> DataFrame:
    """Richness table with the index added; areas without one keep a null."""
    return richness.join(shannon, key, "left")


def area_metrics(
    df: DataFrame, key: str, id_col: str | None = None, geom_col: str | None = None,
    observation: str = "gbifID",
) -> DataFrame:
    """Richness and Shannon index per area, from one pass over the rows."""
    return _area_summary(df, key, id_col, geom_col, observation, index=True)


def park_taxa(df: DataFrame, key: str = "park_name", id_col: str = "park_id",
              geom_col: str | None = None) -> DataFrame:
    """Non-null species count per (area, kingdom, class, genus, species).

    Null taxa keep their group, with count 0; so does a null area.
    """
    keys = [key, "kingdom", "class", "genus", "species"]
    if isinstance(df.schema[id_col].dataType, T.NumericType):
        counts = df.groupBy(*keys).agg(
            F.count("species").alias("species_count"), F.min(_q(id_col)).alias(id_col)
        )
    else:
        # A text id inside min would make the wide aggregation sort; group by it first.
        counts = (
            df.groupBy(*keys, id_col)
            .agg(F.count("species").alias("_n"))
            .groupBy(*keys)
            .agg(F.sum("_n").alias("species_count"), F.min(_q(id_col)).alias(id_col))
        )
    if geom_col:
        shapes = any_per_key(keep_keyed(df, key), key, geom_col)
        counts = counts.join(shapes, key, "left")
    return counts


def by_taxa(df: DataFrame, key: str = "park_name") -> DataFrame:
    """Area, then rank by rank; nulls last."""
    return df.orderBy(*[F.asc_nulls_last(c) for c in [key, "kingdom", "class", "genus", "species"]])


def annual_observations(df: DataFrame) -> DataFrame:
    """Distinct occurrences per year."""
    return df.groupBy("year").agg(F.count_distinct("gbifID").alias("annual_observations"))


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("year"))


def most_observed_species(df: DataFrame) -> DataFrame:
    """Rows per species, null included."""
    return df.groupBy("species").agg(F.count("*").alias("observations"))


def most_observed_first(df: DataFrame, k: int | None = None) -> DataFrame:
    """Most rows first; ``k`` keeps the head, found per task before anything is merged."""
    out = df.orderBy(F.desc_nulls_last("observations"), F.asc_nulls_last("species"))
    return out if k is None else out.limit(k)


def total_species(df: DataFrame) -> DataFrame:
    """Distinct species over all rows; nulls do not count."""
    return df.agg(F.count_distinct("species").alias("total_species"))


def rank_counts(df: DataFrame, rank: str, key: str = "park_name") -> DataFrame:
    """Rows per (area, rank value)."""
    return df.groupBy(key, rank).agg(F.count("*").alias("count"))


def kingdom_class_pairs(df: DataFrame, key: str = "park_name") -> DataFrame:
    """Per area the kingdoms and classes that occur together, with the rows of the pair, of the
    kingdom and of the class. One pass; pairs that never occur are left out."""
    pairs = keep_keyed(df, key).groupBy(key, "kingdom", "class").agg(F.count("*").alias("pair_count"))
    by_kingdom = Window.partitionBy(key, "kingdom")
    by_class = Window.partitionBy(key, "class")
    return pairs.select(
        "*", F.sum("pair_count").over(by_kingdom).alias("kingdom_count"),
        F.sum("pair_count").over(by_class).alias("class_count"),
    )


def taxa_summary(df: DataFrame, key: str = "park_name") -> DataFrame:
    """Richness per area with how many kingdom and class groups it has and their row total.

    Richness and groups come from one pass; a null rank is a group, but no taxon.
    """
    counts, tests = _value_counts(keep_keyed(df, key), key, ["gbifID", *RANKS, "class"])
    wanted = [F.count(F.when(tests["gbifID"], F.col("gbifID"))).alias("observation")]
    wanted += [F.count(F.when(tests[r], _q(r))).alias(n) for r, n in RANKS.items()]
    for rank in ("kingdom", "class"):
        wanted.append(F.count_if(tests[rank]).alias(f"{rank}_groups"))
        wanted.append(F.sum(F.when(tests[rank], F.col("_n"))).alias(f"{rank}_count"))
    return counts.groupBy(_AREA).agg(*wanted).withColumnRenamed(_AREA, key)


# --- planned reports ----------------------------------------------------------------------

def top_species_by_kingdom(df: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most observed species of each kingdom, ties in name order."""
    counts = df.where("species IS NOT NULL").groupBy("kingdom", "species").agg(
        F.count("*").alias("observations")
    )
    w = Window.partitionBy("kingdom").orderBy(F.desc("observations"), "species")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_observers(df: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` observers with most rows."""
    counts = df.groupBy("recordedBy").agg(F.count("*").alias("observations"))
    return counts.orderBy(F.desc("observations"), F.asc_nulls_last("recordedBy")).limit(k)


def season(month: str = "month") -> Column:
    """Meteorological season of the northern hemisphere."""
    m = F.col(month)
    return (
        F.when(m.isin(12, 1, 2), "winter")
        .when(m.isin(3, 4, 5), "spring")
        .when(m.isin(6, 7, 8), "summer")
        .when(m.isin(9, 10, 11), "autumn")
    )


def seasonal_trend(df: DataFrame) -> DataFrame:
    """Occurrences and species per season."""
    tagged = df.select(season().alias("season"), "gbifID", "species")
    counts, tests = _value_counts(tagged, "season", ["gbifID", "species"])
    return counts.groupBy(_AREA).agg(
        F.count(F.when(tests["gbifID"], F.col("gbifID"))).alias("observations"),
        F.count(F.when(tests["species"], F.col("species"))).alias("species_richness"),
    ).withColumnRenamed(_AREA, "season")


def dataset_summary(df: DataFrame) -> DataFrame:
    """Parks, distinct occurrences and rows, one line each (``measure``, ``value``)."""
    everything = df.withColumn("_all", F.lit(1))
    counts, tests = _value_counts(everything, "_all", ["park_name", "gbifID"])
    one = counts.agg(
        F.count(F.when(tests["park_name"], F.col("park_name"))).alias("parks"),
        F.count(F.when(tests["gbifID"], F.col("gbifID"))).alias("observations"),
        F.coalesce(F.sum(F.when(tests["park_name"], F.col("_n"))), F.lit(0)).alias("rows"),
    )
    return one.select(F.expr(
        "stack(3, 'parks', parks, 'observations', observations, 'rows', rows) AS (measure, value)"
    ))


def observations_by_kingdom(df: DataFrame) -> DataFrame:
    """Distinct occurrences per kingdom."""
    return df.groupBy("kingdom").agg(F.count_distinct("gbifID").alias("observations"))


def park_species_matrix(df: DataFrame, kingdoms: list[str], key: str = "park_name") -> DataFrame:
    """Distinct species per area, one column per kingdom (absent: 0), and ``other`` for species of
    kingdoms that are null or not listed, so that none vanishes."""
    species = (
        keep_keyed(df, key).where("species IS NOT NULL").select(key, "kingdom", "species").distinct()
    )
    return species.groupBy(key).agg(
        *[F.count_if(F.col("kingdom") == k).alias(k.lower()) for k in kingdoms],
        F.count_if(~F.coalesce(F.col("kingdom").isin(kingdoms), F.lit(False))).alias("other"),
    )


def compare_areas(df: DataFrame, key: str, first: object, second: object) -> DataFrame:
    """Species found in both of two areas, and in one only."""
    seen = df.where(_q(key).isin(first, second) & F.col("species").isNotNull())
    by_species = seen.groupBy("species").agg(
        F.bool_or(_q(key) == F.lit(first)).alias("a"), F.bool_or(_q(key) == F.lit(second)).alias("b")
    )
    return by_species.agg(
        F.count_if(F.col("a") & F.col("b")).alias("shared"),
        F.count_if(F.col("a") & ~F.col("b")).alias("first_only"),
        F.count_if(F.col("b") & ~F.col("a")).alias("second_only"),
    )


def compare_all_areas(df: DataFrame, key: str = "park_name", **options: object) -> DataFrame:
    """``first``, ``second`` (the smaller name first), ``shared``, ``first_only``, ``second_only`` for
    every pair of areas that have a species in common.

    Sets of species are joined with themselves by species, so only pairs that share one meet; species
    of very many areas are split by the join's own rule (``options`` are those of ``sized_join``), and
    shared species are counted before pairs are shuffled. Null areas and species are left out.
    """
    sets = keep_keyed(df, key).where("species IS NOT NULL").select(_q(key).alias("area"), "species").distinct()
    sets = stored(sets, "species_of_areas")
    sizes = sets.groupBy("area").agg(F.count("*").alias("n"))
    pairs = sized_join(
        sets, sets.withColumnRenamed("area", "other"), ["species"], F.col("l.area") < F.col("r.other"), "inner", **options
    ).groupBy(F.col("l.area").alias("first"), F.col("r.other").alias("second")).agg(F.count("*").alias("shared"))
    sized = pairs.join(sizes.withColumnsRenamed({"area": "first", "n": "n_first"}), "first").join(
        sizes.withColumnsRenamed({"area": "second", "n": "n_second"}), "second"
    )
    return sized.selectExpr(
        "first", "second", "shared", "n_first - shared AS first_only", "n_second - shared AS second_only"
    )


def search(df: DataFrame, column: str, term: str) -> DataFrame:
    """Rows whose ``column`` contains ``term``, letter case ignored."""
    return df.where(F.lower(_q(column)).contains(term.lower()))
