"""Joins, aggregates, reshaping and grids, each a plain DataFrame expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandweave import schema
from bandweave.functions import text
from bandweave.sources.sinks import settled

JOIN_TYPES = ("inner", "left", "right", "full")
#: The largest side that is broadcast, in rows of a few columns.
BROADCAST_ROWS = 100_000


def join_on(left: DataFrame, right: DataFrame, key: str, join_type: str = "inner") -> DataFrame:
    """Equi join; repeats multiply rows and NULL keys match nothing."""
    if join_type not in JOIN_TYPES:
        raise ValueError(f"join_type must be one of {', '.join(JOIN_TYPES)}")
    return left.join(right, key, join_type)


def unmatched_counts(left: DataFrame, right: DataFrame, key: str) -> tuple[int, int]:
    return left.join(right, key, "left_anti").count(), right.join(left, key, "left_anti").count()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has few rows; the count stops one row past the limit."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def zscore_join(rows: DataFrame, covariates: DataFrame, key: str, columns: list[str] | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    """rows left-joined with covariates that are standardised over their whole table, or over the keys of fit_on.

    A constant covariate gives NULL. The means are one aggregate row.
    """
    columns = columns or [c for c, t in covariates.dtypes if c != key and t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal") and c != key]
    basis = covariates if fit_on is None else covariates.join(fit_on.select(key).distinct(), key, "left_semi")
    stats = basis.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    scaled = covariates.crossJoin(F.broadcast(stats)).select(key, *[F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(c) for c in columns])
    return rows.join(scaled, key, "left")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


#: Groups of more rows take the way around a bracket; the share of ranks on either side of a quantile that the bracket
#: holds, and the accuracy of its ends (their error in ranks is the inverse of it).
DIRECT_ROWS, BRACKET, ACCURACY = 100_000, 5e-4, 10_000


def quantiles(rows: DataFrame, value: str, shares: list[float], by: list[str] | None = None, direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """(by, q0, q1, ...): the exact quantiles, interpolated between neighbours (type 7), of the values that are not NULL.

    A group of up to direct_rows rows is sorted at once. In larger ones approximate quantiles bracket each wanted rank;
    the rows below the bracket are counted, and only the distinct values inside it are put in order.
    """
    by, names = by or [], [f"q{i}" for i in range(len(shares))]
    clean = rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    sizes = clean.groupBy(*by).agg(F.count("*").alias("_n"))
    meet = lambda left, right: left.join(right, [*by]) if by else left.crossJoin(F.broadcast(right))
    if sizes.where(F.col("_n") > direct_rows).isEmpty():
        return clean.groupBy(*by).agg(*[F.percentile("_v", p).alias(n) for n, p in zip(names, shares, strict=True)])
    few = meet(clean, small(sizes.where(F.col("_n") <= direct_rows)) if by else sizes.where(F.col("_n") <= direct_rows))
    direct = few.groupBy(*by).agg(*[F.percentile("_v", p).alias(n) for n, p in zip(names, shares, strict=True)])
    ends = [min(max(p + d, 0.0), 1.0) for p in shares for d in (-BRACKET, BRACKET)]
    ends = clean.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_v", ends, ACCURACY).alias("_e")).where(F.col("_n") > direct_rows)
    at = [F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"), F.get("_e", F.lit(2 * i)).alias("lo"), F.get("_e", F.lit(2 * i + 1)).alias("hi")) for i, p in enumerate(shares)]
    ends = ends.select(*by, "_n", F.array(*at).alias("_e"))
    held = meet(clean, small(ends) if by else ends).select(*by, "_n", "_v", F.explode("_e").alias("_e")).where("_v <= _e.hi")
    # what is below the bracket counts as one value
    counts = held.groupBy(*by, "_e.i", "_e.p", "_n", F.when(F.col("_v") >= F.col("_e.lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by, "i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    rank = (F.col("_n") - 1) * F.col("p")
    found = counts.withColumn("upto", upto).groupBy(*by, "i").agg(
        F.min(F.when(F.col("upto") > F.floor(rank), F.col("_v"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil(rank), F.col("_v"))).alias("b"), F.first(rank - F.floor(rank)).alias("t")
    )
    value_of = F.col("a") + F.when(F.col("b") > F.col("a"), F.col("t") * (F.col("b") - F.col("a"))).otherwise(0.0)
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("i") == i, value_of)).alias(n) for i, n in enumerate(names)])
    return direct.unionByName(wide) if by else wide


def running_below(rows: DataFrame, by: list[str], value: str, weight: str, buckets: int = 64) -> DataFrame:
    """rows with _below: the weight of the rows of the group with a lower value. (by, value) do not repeat.

    The groups are cut at approximate quantiles, so that no task orders a whole group: inside a piece the weights are
    added up in order, and the pieces before it are added as a whole.
    """
    cuts = rows.groupBy(*by).agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 1000).alias("_cuts"))
    meet = rows.join(small(cuts), by) if by else rows.crossJoin(F.broadcast(cuts))
    piece = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    cut = meet.withColumn("_piece", piece).drop("_cuts")
    totals = cut.groupBy(*by, "_piece").agg(F.sum(weight).alias("_w"))
    before = F.sum("_w").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*by, "_piece", F.coalesce(before, F.lit(0)).alias("_before"))  # at most buckets rows a group
    inside = F.sum(weight).over(Window.partitionBy(*by, "_piece").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    out = cut.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(small(totals), [*by, "_piece"])
    return out.withColumn("_below", F.col("_before") + F.col("_inside")).drop("_piece", "_before", "_inside")


#: Bytes of the centers that travel in one row.
CENTER_BYTES = 64 << 20


def _checked(centers: DataFrame, center: str) -> None:
    n, width = centers.agg(F.count("*"), F.max(F.size(center))).first()
    if n * (width or 0) * 8 > CENTER_BYTES:
        raise ValueError(f"{n} centers of {width} values are too many to broadcast")


def nearest_centroid(points: DataFrame, centers: DataFrame, key: str, vector: str = "x", center: str = "center", cluster: str = "cluster") -> DataFrame:
    """points with the nearest center (of CENTER_BYTES in all) and its distance; the lowest cluster wins a tie.

    The centers travel as one array in one broadcast row, so that no pair of rows is made.
    """
    _checked(centers, center)
    table = centers.agg(F.array_sort(F.collect_list(F.struct(F.col(cluster).alias("k"), F.col(center).alias("c")))).alias("_centers"))
    best = F.array_min(F.transform("_centers", lambda p: F.struct(squared_distance(F.col(vector), p["c"]).alias("d"), p["k"].alias("k"))))
    return points.crossJoin(F.broadcast(table)).withColumn("_best", best).select(*points.columns, F.col("_best.k").alias(cluster), F.sqrt("_best.d").alias("distance"))


def distance_pool(points: DataFrame, centers: DataFrame, key: str, percentile: float = 0.6, vector: str = "x", center: str = "center", cluster: str = "cluster") -> DataFrame:
    """(key, cluster, distance) of the points within each center's distance quantile; a point may be in several pools."""
    _checked(centers, center)
    pairs = points.select(key, vector).crossJoin(F.broadcast(centers.select(cluster, center)))
    pairs = settled(pairs.select(key, cluster, F.sqrt(squared_distance(F.col(vector), F.col(center))).alias("distance")))
    return coverage_filter(pairs, percentile, [cluster])


def coverage_filter(pool: DataFrame, coverage: float = 0.8, by: list[str] | None = None) -> DataFrame:
    """The rows of each pool within its own distance quantile."""
    by = by or ["cluster"]
    return pool.join(small(quantiles(pool, "distance", [coverage], by)), by).where("distance <= q0").drop("q0")


def replicate_average(rows: DataFrame, by: list[str], mean: list[str], order_by: str) -> DataFrame:
    """Mean of columns per group (NaN left out), n_replicates, and the other columns of the first row by order_by."""
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    rest = [c for c in rows.columns if c not in by and c not in mean]
    return rows.groupBy(*by).agg(*[F.avg(clean(c)).alias(c) for c in mean], F.count("*").alias("n_replicates"), *[F.min_by(c, order_by).alias(c) for c in rest])


def spectra_average(rows: DataFrame, by: list[str], order_by: str, spectrum: str = "spectrum") -> DataFrame:
    """replicate_average for an array: means band by band, missing and NaN bands left out; a band without values is NULL."""
    rest = [c for c in rows.columns if c not in by and c != spectrum]
    bands = rows.select(*by, F.posexplode_outer(spectrum).alias("_band", "_v"))
    means = bands.groupBy(*by, "_band").agg(F.avg(F.when(~F.isnan("_v"), F.col("_v"))).alias("_v"))
    arrays = means.where("_band IS NOT NULL").groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_band", "_v"))), lambda p: p["_v"]).alias(spectrum))
    whole = rows.groupBy(*by).agg(F.count("*").alias("n_replicates"), *[F.min_by(c, order_by).alias(c) for c in rest])
    safe = lambda side: side.withColumn("_key", F.xxhash64(*by))  # noqa: E731  so that NULL keys meet
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    condition = F.col("a._key") == F.col("b._key")
    for s in same:
        condition = condition & s
    joined = safe(whole).alias("a").join(safe(arrays).alias("b"), condition, "left")
    return joined.select(*[F.col(f"a.{c}") for c in by], F.col(f"b.{spectrum}").alias(spectrum), "a.n_replicates", *[F.col(f"a.{c}") for c in rest])


def repeated(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def annual_climate(daily: DataFrame, cell: list[str], base: float = 10.0) -> DataFrame:
    """MAT, MAP, PET (a daily mean), GDD and AI = MAP / PET of each cell: means over years of yearly values.

    daily: cell, year, temperature, precipitation, pet.
    """
    from bandweave.functions.climate import degree_days

    yearly = daily.groupBy(*cell, "year").agg(
        F.avg("temperature").alias("t"), F.sum("precipitation").alias("p"), F.avg("pet").alias("e"), F.sum(degree_days("temperature", base)).alias("g")
    )
    out = yearly.groupBy(*cell).agg(F.avg("t").alias("MAT"), F.avg("p").alias("MAP"), F.avg("e").alias("PET"), F.avg("g").alias("GDD"))
    return out.withColumn("AI", F.col("MAP") / F.nullif(F.col("PET"), F.lit(0.0)))


def precipitation_seasonality(daily: DataFrame, cell: list[str]) -> DataFrame:
    """100 * sd / mean over the mean monthly sums. daily: cell, year, month, precipitation."""
    monthly = daily.groupBy(*cell, "year", "month").agg(F.sum("precipitation").alias("p"))
    months = monthly.groupBy(*cell, "month").agg(F.avg("p").alias("p"))
    return months.groupBy(*cell).agg((100 * F.stddev_samp("p") / F.nullif(F.avg("p"), F.lit(0.0))).alias("Precip_Seasonality"))


def cell_centroids(points: DataFrame, longitude: str, latitude: str) -> DataFrame:
    from bandweave.functions.climate import cell_index

    return points.groupBy(cell_index(longitude).alias("cell_x"), cell_index(latitude).alias("cell_y")).agg(F.avg(longitude).alias("longitude"), F.avg(latitude).alias("latitude"), F.count("*").alias("n"))


def union_fill(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def top_n(results: DataFrame, metric: str, n: int, tie: str = "config_id") -> DataFrame:
    """The n best rows by a metric, in its own direction; NULLs come last and ties go by another column."""
    from bandweave.functions.metrics import LARGER_IS_BETTER

    column = F.col(metric)
    order = column.desc_nulls_last() if LARGER_IS_BETTER[metric] else column.asc_nulls_last()
    return results.orderBy(order, tie).limit(n)


def hashed_sample(rows: DataFrame, key: str, n: int, seed: int = 307) -> DataFrame:
    """n rows chosen by a hash of the key: the same for any partitioning."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def quartile_bin(rows: DataFrame, value: str, name: str = "bin", by: list[str] | None = None) -> DataFrame:
    """Q1 to Q4 by the exact quartiles, the lowest value included; tied breaks merge bins. NULL stays NULL."""
    by = by or []
    cuts = quantiles(rows, value, [0.25, 0.5, 0.75], by)
    joined = rows.join(small(cuts), by) if by else rows.crossJoin(F.broadcast(cuts))
    v = F.col(value)
    label = F.when(v <= F.col("q0"), "Q1").when(v <= F.col("q1"), "Q2").when(v <= F.col("q2"), "Q3").when(v.isNotNull(), "Q4")
    return joined.withColumn(name, label).drop("q0", "q1", "q2")


def stratified_rank(rows: DataFrame, value: str, order: Column, by: list[str] | None = None, pieces: int = 256) -> DataFrame:
    """Adds bin, rank within the bin (from 1) by order, a struct of a number and the key, and the bin's size.

    The bins are cut into pieces at approximate quantiles of the number, so that no task orders a whole bin.
    """
    part = [*(by or []), "bin"]
    binned = quartile_bin(rows, value, "bin", by).withColumn("_order", order)
    number = F.col("_order").getField(next(f.name for f in binned.schema["_order"].dataType.fields))
    cuts = binned.agg(F.percentile_approx(number, [i / pieces for i in range(1, pieces)], 10_000).alias("_cuts"))
    binned = binned.crossJoin(F.broadcast(cuts)).withColumn("_piece", F.size(F.filter("_cuts", lambda c: c < number))).drop("_cuts")
    sizes = binned.groupBy(*part, "_piece").agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*part)
    before = F.sum("_n").over(over.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*part, "_piece", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(over).alias("bin_size"))
    inside = F.row_number().over(Window.partitionBy(*part, "_piece").orderBy("_order"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in part] + [F.col("a._piece") == F.col("b._piece")]
    condition = same[0]
    for x in same[1:]:
        condition = condition & x
    joined = binned.withColumn("_inside", inside).alias("a").join(small(sizes).alias("b"), condition)
    return joined.select(*[F.col(f"a.{c}") for c in binned.columns if c not in ("_order", "_piece")], (F.col("b._before") + F.col("a._inside")).alias("rank"), "b.bin_size")


def stratified_split(rows: DataFrame, value: str, key: str, train_share: float = 0.8, seed: int = 307, by: list[str] | None = None, order: Column | None = None) -> DataFrame:
    """rows with split (train or test): the share of each quartile with the lowest hashes is for training."""
    order = F.struct(F.xxhash64(key, F.lit(seed)), F.col(key)) if order is None else order
    ranked = stratified_rank(rows, value, order, by)
    return ranked.withColumn("split", F.when(F.col("rank") <= F.floor(F.col("bin_size") * train_share + 1e-9), "train").otherwise("test")).drop("rank", "bin_size")


def folds(rows: DataFrame, value: str, key: str, v: int = 10, seed: int = 307, order: Column | None = None) -> DataFrame:
    """rows with fold 0 to v - 1, each quartile dealt evenly."""
    order = F.struct(F.xxhash64(key, F.lit(seed)), F.col(key)) if order is None else order
    return stratified_rank(rows, value, order).withColumn("fold", ((F.col("rank") - 1) % v).cast("int")).drop("rank", "bin_size")


def power_set(spark: SparkSession, names: list[str]) -> DataFrame:
    """covariates: NULL for none and every subset, in the order of the names."""
    if len(names) > 20:
        raise ValueError("over a million subsets")
    array = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    subset = F.filter(array, lambda x, i: (F.floor(F.col("id") / F.pow(F.lit(2.0), i)) % 2) == 1)
    return spark.range(0, 2 ** len(names), 1, 1).select(F.when(F.col("id") > 0, subset).alias("covariates"))


def crossing(spark: SparkSession, **factors: list) -> DataFrame:
    """Sorted product of the distinct values of each factor."""
    out = None
    for name, values in factors.items():
        one = spark.createDataFrame([(v,) for v in sorted(set(values))], f"{name} string").coalesce(1)
        out = one if out is None else out.crossJoin(one)
    return out.orderBy(*factors)


def create_configs(spark: SparkSession, models=("random_forest",), transformations=("none",), preprocessing=("raw",), feature_selection=("none",), soil_covariates=(), climate_covariates=(), spatial_covariates=(), interactions=(False,)) -> DataFrame:
    """The configuration grid with config_id config_0001 and on, in the order of its columns."""
    if "pls" in feature_selection:
        raise ValueError("feature selection pls is not supported")
    if spatial_covariates:
        raise ValueError("spatial covariates are not supported")
    grid = crossing(spark, model=list(models), transformation=list(transformations), preprocessing=list(preprocessing), feature_selection=list(feature_selection))
    flags = spark.createDataFrame([(bool(i),) for i in sorted(set(interactions))], "covariate_interactions boolean").coalesce(1)
    grid = grid.crossJoin(power_set(spark, [*soil_covariates, *climate_covariates])).crossJoin(flags)
    names = F.coalesce(F.array_join("covariates", "_"), F.lit(""))
    order = ["model", "transformation", "preprocessing", "feature_selection", F.coalesce(F.size("covariates"), F.lit(0)), names, "covariate_interactions"]
    # the grid is driver-made and small, so that one sorted partition for the numbering is right
    numbered = grid.withColumn("config_id", F.format_string("config_%04d", F.row_number().over(Window.orderBy(*order))))
    return numbered.select("config_id", "model", "transformation", "preprocessing", "feature_selection", "covariates", "covariate_interactions")


def with_workflow_id(configs: DataFrame) -> DataFrame:
    return configs.withColumn("workflow_id", text.workflow_id("model", "transformation", "preprocessing", "feature_selection", "covariates", "covariate_interactions"))


def cluster_members(rows: DataFrame, cluster: str, member: str) -> DataFrame:
    return rows.groupBy(cluster).agg(F.array_sort(F.collect_list(member)).alias("members"))


def property_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(schema.SOIL_PROPERTIES), schema.PROPERTY_SCHEMA)


def iqr_outliers(rows: DataFrame, value: str, cutoff: float = 1.5) -> DataFrame:
    """rows with response_outlier: strictly outside the Tukey fences of the usable values."""
    clean = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    fences = quantiles(rows.select(clean.alias("v")), "v", [0.25, 0.75]).withColumnsRenamed({"q0": "_a", "q1": "_b"})
    width = F.col("_b") - F.col("_a")
    flag = F.coalesce((clean < F.col("_a") - cutoff * width) | (clean > F.col("_b") + cutoff * width), F.lit(False))
    return rows.crossJoin(F.broadcast(fences)).withColumn("response_outlier", flag).drop("_a", "_b")


def skewness_proxy(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, skew): (mean - median) / sd of each group."""
    by = by or []
    moments = rows.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    medians = quantiles(rows, value, [0.5], by)
    joined = moments.join(medians, by, "left") if by else moments.crossJoin(F.broadcast(medians))
    return joined.select(*by, ((F.col("_m") - F.col("q0")) / F.nullif(F.col("_s"), F.lit(0.0))).alias("skew"))


def prune_flags(results: DataFrame, train_mean: float, train_sd: float, threshold: float = 0.9) -> DataFrame:
    """results (with rrmse of the best grid point) with baseline and pruned; a zero mean prunes nothing."""
    if abs(train_mean) < 2.220446049250313e-16:
        return results.withColumn("baseline", F.lit(None).cast("double")).withColumn("pruned", F.lit(False))
    base = 100 * train_sd / abs(train_mean)
    bad = (F.col("rrmse") > base * threshold) | (F.col("rrmse") == float("inf"))
    return results.withColumn("baseline", F.lit(base)).withColumn("pruned", F.coalesce(bad, F.lit(False)))
