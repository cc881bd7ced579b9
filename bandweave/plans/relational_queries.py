"""Metrics, joins, aggregates, reshaping, grids and identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandweave import schema
from bandweave.functions import climate, metrics, text
from bandweave.operators import relational as rel
from bandweave.plans.catalog import r6, register, table

_PAIRS = """
p AS (SELECT l_returnflag, l_linestatus, CAST(l_extendedprice AS DOUBLE) AS t, CAST(l_extendedprice * (1 - l_discount) AS DOUBLE) AS e FROM lineitem)
"""
_METRICS = {
    "rsq": "power(corr(t, e), 2)",
    "ccc": "2 * covar_samp(t, e) / (var_samp(t) + var_samp(e) + power(avg(t) - avg(e), 2))",
    "rpd": "stddev_samp(t) / sqrt(avg((t - e) * (t - e)))",
    "rmse": "sqrt(avg((t - e) * (t - e)))",
    "rrmse": "100 * sqrt(avg((t - e) * (t - e))) / avg(t)",
    "mae": "avg(abs(t - e))",
}
_SET = ", ".join(f"round({sql}, 6) AS {name}" for name, sql in _METRICS.items())


def _pairs(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("t"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("e"))


@register("metrics_by_group", f"WITH {_PAIRS} SELECT l_returnflag, {_SET} FROM p GROUP BY 1")
def metrics_by_group(spark, sf_dir):
    wide = metrics.metrics_wide(_pairs(spark, sf_dir), "t", "e", ["l_returnflag"])
    return wide.select("l_returnflag", *[r6(m).alias(m) for m in metrics.METRICS])


@register("metrics_long", f"WITH {_PAIRS} " + " UNION ALL ".join(f"SELECT l_returnflag, '{n}' AS metric, 'standard' AS estimator, round({s}, 6) AS estimate FROM p GROUP BY 1" for n, s in _METRICS.items()))
def metrics_long(spark, sf_dir):
    long = metrics.metrics_long(_pairs(spark, sf_dir), "t", "e", ["l_returnflag"])
    return long.withColumn("estimate", r6("estimate"))


@register("metrics_wide", f"WITH {_PAIRS} SELECT l_returnflag, l_linestatus, {_SET} FROM p GROUP BY 1, 2")
def metrics_wide(spark, sf_dir):
    by = ["l_returnflag", "l_linestatus"]
    wide = metrics.long_to_wide(metrics.metrics_long(_pairs(spark, sf_dir), "t", "e", by), by)
    return wide.select(*by, *[r6(m).alias(m) for m in metrics.METRICS])


@register("metric_mean_std_err", f"WITH {_PAIRS}, m AS (SELECT l_returnflag, l_linestatus, sqrt(avg((t - e) * (t - e))) AS v FROM p GROUP BY 1, 2) SELECT l_returnflag, 'rmse' AS metric, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(*)), 6) AS std_err, count(*)::BIGINT AS n FROM m GROUP BY 1")
def metric_mean_std_err(spark, sf_dir):
    long = metrics.metrics_long(_pairs(spark, sf_dir), "t", "e", ["l_returnflag", "l_linestatus"], ("rmse",))
    return metrics.mean_and_error(long, ["l_returnflag"]).withColumns({"mean": r6("mean"), "std_err": r6("std_err")})


@register(
    "metric_bands",
    f"WITH {_PAIRS}, m AS (SELECT l_returnflag, l_linestatus, {_METRICS['rpd']} AS rpd, {_METRICS['ccc']} AS ccc FROM p GROUP BY 1, 2) "
    "SELECT l_returnflag, l_linestatus, CASE WHEN rpd < 1.5 THEN 'poor' WHEN rpd < 2 THEN 'fair' WHEN rpd <= 2.5 THEN 'good' ELSE 'excellent' END AS rpd_band, "
    "CASE WHEN ccc < .65 THEN 'poor' WHEN ccc < .8 THEN 'moderate' WHEN ccc <= .9 THEN 'substantial' ELSE 'excellent' END AS ccc_band FROM m",
)
def metric_bands(spark, sf_dir):
    by = ["l_returnflag", "l_linestatus"]
    wide = metrics.metrics_wide(_pairs(spark, sf_dir), "t", "e", by, ("rpd", "ccc"))
    return wide.select(*by, metrics.rpd_band("rpd").alias("rpd_band"), metrics.ccc_band("ccc").alias("ccc_band"))


@register("replicate_average", "SELECT user_id, round(avg(value), 6) AS value, count(*)::BIGINT AS n_replicates, min(ts) AS ts, arg_min(event_type, ts) AS event_type FROM events GROUP BY 1")
def replicate_average(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "value", "ts", "event_type")
    return rel.replicate_average(rows, ["user_id"], ["value"], "ts").withColumn("value", r6("value"))


@register("replicate_counts", "SELECT user_id, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def replicate_counts(spark, sf_dir):
    return rel.repeated(table(spark, sf_dir, "events"), ["user_id", "event_type"])


def _sides(spark, sf_dir):
    """Every fifth key has a vector, up to beyond the customers' keys: either side has keys that the other lacks."""
    left = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 5).alias("key"), F.col("label").cast("double").alias("label"))
    return left, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal")


_SIDES = "WITH a AS (SELECT vec_id * 5 AS key, label::DOUBLE AS label FROM embeddings), b AS (SELECT c_custkey AS key, c_acctbal FROM customer) "
for _kind in rel.JOIN_TYPES:

    def _join(spark, sf_dir, kind=_kind):
        return rel.join_on(*_sides(spark, sf_dir), "key", kind)

    register(f"join_{_kind}", _SIDES + f"SELECT key, label, c_acctbal FROM a {_kind} JOIN b USING (key)")(_join)


@register("join_semi", "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def join_semi(spark, sf_dir):
    large = table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@register("join_anti", "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def join_anti(spark, sf_dir):
    large = table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


def _report(a, b):
    left, right = a.join(b, "key", "left_anti"), b.join(a, "key", "left_anti")
    count = lambda df, side: df.agg(F.count("*").alias("dropped")).select(F.lit(side).alias("side"), "dropped")
    return count(left, "left").unionByName(count(right, "right"))


@register("join_report", _SIDES + "SELECT 'left' AS side, count(*)::BIGINT AS dropped FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT 'right', count(*)::BIGINT FROM b WHERE key NOT IN (SELECT key FROM a)")
def join_report(spark, sf_dir):
    return _report(*_sides(spark, sf_dir))


@register("join_multiway", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal IS NOT NULL")
def join_multiway(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = table(spark, sf_dir, "customer").dropna(subset=["c_acctbal"])
    rows = rows.join(rel.small(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.join(rel.small(region), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@register("covariate_zscore_join", "WITH s AS (SELECT c_custkey, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER () AS z FROM customer) SELECT o_orderkey, o_custkey, round(z, 6) AS c_acctbal FROM orders LEFT JOIN s ON o_custkey = c_custkey")
def covariate_zscore_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    covariates = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return rel.zscore_join(orders, covariates, "o_custkey").withColumn("c_acctbal", r6("c_acctbal"))


_LONG = "WITH l AS (SELECT p_partkey, 'size' AS name, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part) "


@register("property_unpivot", _LONG + "SELECT p_partkey, name, value FROM l")
def property_unpivot(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return rows.unpivot("p_partkey", ["size", "price"], "name", "value")


@register("property_unpivot_pivot", _LONG + ", k(name, property) AS (VALUES ('size', 'clay'), ('price', 'sand')) SELECT p_partkey, max(value) FILTER (property = 'clay') AS clay, max(value) FILTER (property = 'sand') AS sand FROM l LEFT JOIN k USING (name) GROUP BY 1")
def property_unpivot_pivot(spark, sf_dir):
    names = spark.createDataFrame([("size", "clay"), ("price", "sand")], "name string, property string")
    long = property_unpivot(spark, sf_dir).join(F.broadcast(names), "name", "left")
    return long.groupBy("p_partkey").pivot("property", ["clay", "sand"]).agg(F.first("value"))


@register("library_training_set", "WITH t AS (SELECT DISTINCT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL) SELECT c_custkey, n_name, round(c_acctbal, 6) AS c_acctbal FROM t JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_custkey IN (SELECT o_custkey FROM orders)")
def library_training_set(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal").distinct().dropna(subset=["c_acctbal"])
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.join(rel.small(place), F.col("c_nationkey") == F.col("n_nationkey"))
    seen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return rows.join(seen, "c_custkey", "left_semi").select("c_custkey", "n_name", r6("c_acctbal").alias("c_acctbal"))


@register("parse_ids", "SELECT c_custkey, split_part(c_name, '#', 1) AS \"Project\", split_part(c_name, '#', 2) AS \"Sample_ID\", 'GroundBulk' AS \"Fraction\" FROM customer")
def parse_ids(spark, sf_dir):
    parts = text.parse_file_name("c_name", "project#sampleid", "#")
    return table(spark, sf_dir, "customer").select("c_custkey", *[parts[c].alias(c) for c in ("Project", "Sample_ID", "Fraction")])


@register("parse_ids_short", "SELECT c_custkey, 'UNKNOWN' AS \"Sample_ID\", CAST(NULL AS VARCHAR) AS \"Project\" FROM customer")
def parse_ids_short(spark, sf_dir):
    parts = text.parse_file_name("c_name", "project#sampleid#scanid", "#")
    return table(spark, sf_dir, "customer").select("c_custkey", parts["Sample_ID"].alias("Sample_ID"), parts["Project"].alias("Project"))


@register("iqr_outliers", "WITH f AS (SELECT quantile_cont(o_totalprice, .25) AS a, quantile_cont(o_totalprice, .75) AS b FROM orders) SELECT o_orderkey, CASE WHEN o_totalprice < a - .5 * (b - a) OR o_totalprice > b + .5 * (b - a) THEN 'outlier' ELSE 'good' END AS outlier_flag FROM orders, f")
def iqr_outliers(spark, sf_dir):
    rows = rel.iqr_outliers(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.5)
    return rows.select("o_orderkey", F.when(F.col("response_outlier"), "outlier").otherwise("good").alias("outlier_flag"))


@register("skewness_proxy", "SELECT c_mktsegment, round((avg(c_acctbal) - median(c_acctbal)) / stddev_samp(c_acctbal), 6) AS skew, round(quantile_cont(c_acctbal, .9), 6) AS q90 FROM customer GROUP BY 1")
def skewness_proxy(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal")
    both = rel.skewness_proxy(rows, "c_acctbal", ["c_mktsegment"]).join(rel.quantiles(rows, "c_acctbal", [0.9], ["c_mktsegment"]), "c_mktsegment")
    return both.select("c_mktsegment", r6("skew").alias("skew"), r6("q0").alias("q90"))


def _daily(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    day = F.dayofyear("o_orderdate")
    t = (F.col("o_totalprice") % 30) + 0.0
    return rows.select(
        (F.col("o_custkey") % 20).alias("cell"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), day.alias("day"),
        t.alias("temperature"), (F.col("o_totalprice") % 7).alias("precipitation"), climate.pet(F.lit(40.0), day, t - 5, t + 5).alias("pet"),
    )


_DAILY = """d AS (SELECT o_custkey % 20 AS cell, year(o_orderdate) AS y, month(o_orderdate) AS m, dayofyear(o_orderdate) AS j, o_totalprice % 30 AS t, o_totalprice % 7 AS p FROM orders),
e AS (SELECT *, greatest(.0023::DOUBLE * (t + 17.8::DOUBLE) * sqrt(10.0::DOUBLE) * (.0820::DOUBLE * 1440 / pi() * acos(-tan(radians(40)) * tan(.409::DOUBLE * cos(2 * pi() * (j - 173) / 365.0::DOUBLE)))), 0) AS pet FROM d)"""


@register("climate_pet", f"WITH {_DAILY} SELECT cell, y::INT AS year, round(avg(pet), 6) AS pet, round(sum(greatest(t - 10, 0)), 4) AS gdd FROM e GROUP BY 1, 2")
def climate_pet(spark, sf_dir):
    return _daily(spark, sf_dir).groupBy("cell", "year").agg(r6(F.avg("pet")).alias("pet"), F.round(F.sum(climate.degree_days("temperature")), 4).alias("gdd"))


@register("climate_annual", f"WITH {_DAILY}, y AS (SELECT cell, y, avg(t) AS t, sum(p) AS p, avg(pet) AS e, sum(greatest(t - 10, 0)) AS g FROM e GROUP BY 1, 2) SELECT cell, round(avg(t), 6) AS mat, round(avg(p), 6) AS map, round(avg(e), 6) AS pet, round(avg(g), 6) AS gdd, round(avg(p) / avg(e), 6) AS ai FROM y GROUP BY 1")
def climate_annual(spark, sf_dir):
    out = rel.annual_climate(_daily(spark, sf_dir), ["cell"])
    return out.select("cell", *[r6(c).alias(c.lower()) for c in ("MAT", "MAP", "PET", "GDD", "AI")])


@register("climate_seasonality", f"WITH {_DAILY}, a AS (SELECT cell, y, m, sum(p) AS p FROM d GROUP BY 1, 2, 3), b AS (SELECT cell, m, avg(p) AS p FROM a GROUP BY 1, 2) SELECT cell, round(100 * stddev_samp(p) / avg(p), 6) AS seasonality FROM b GROUP BY 1")
def climate_seasonality(spark, sf_dir):
    return rel.precipitation_seasonality(_daily(spark, sf_dir), ["cell"]).select("cell", r6("Precip_Seasonality").alias("seasonality"))


_PLACES = "s AS (SELECT s_suppkey, (s_suppkey * 37 % 3600) / 10.0::DOUBLE - 180 AS lon, (s_suppkey * 17 % 1700) / 10.0::DOUBLE - 85 AS lat FROM supplier)"


def _places(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", ((k * 37 % 3600) / 10.0 - 180).alias("lon"), ((k * 17 % 1700) / 10.0 - 85).alias("lat"))


@register("grid_snap", f"WITH {_PLACES} SELECT s_suppkey, round(round_even(lon * 24, 0) / 24, 6) AS cell_lon, round(round_even(lat * 24, 0) / 24, 6) AS cell_lat FROM s")
def grid_snap(spark, sf_dir):
    return _places(spark, sf_dir).select("s_suppkey", r6(climate.snapped("lon")).alias("cell_lon"), r6(climate.snapped("lat")).alias("cell_lat"))


@register("climate_join_back", f"WITH {_PLACES}, c AS (SELECT round_even(lon * 24, 0)::BIGINT AS cx, round_even(lat * 24, 0)::BIGINT AS cy, avg(lat) AS latitude, count(*)::BIGINT AS n FROM s GROUP BY 1, 2) SELECT s_suppkey, round(latitude, 6) AS latitude, n FROM s LEFT JOIN c ON round_even(lon * 24, 0)::BIGINT = cx AND round_even(lat * 24, 0)::BIGINT = cy")
def climate_join_back(spark, sf_dir):
    places = _places(spark, sf_dir)
    cells = rel.cell_centroids(places, "lon", "lat").select("cell_x", "cell_y", r6("latitude").alias("latitude"), "n")
    keyed = places.withColumns({"cell_x": climate.cell_index("lon"), "cell_y": climate.cell_index("lat")})
    return keyed.join(cells, ["cell_x", "cell_y"], "left").select("s_suppkey", "latitude", "n")


@register("day_of_year_date", "SELECT o_orderkey, (make_date(year(o_orderdate), 1, 1) + (dayofyear(o_orderdate) - 1)::INT)::DATE::VARCHAR AS day, month(o_orderdate)::INT AS month FROM orders")
def day_of_year_date(spark, sf_dir):
    day = climate.day_of(F.year("o_orderdate"), F.dayofyear("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", day.cast("string").alias("day"), F.month(day).alias("month"))


@register("power_set", "SELECT i AS id, CASE WHEN i = 0 THEN '' ELSE array_to_string(list_filter(['clay', 'sand', 'MAT'], lambda x, k: (i >> (k - 1)::BIGINT) & 1 = 1), '+') END AS covariates FROM range(8) t(i)")
def power_set(spark, sf_dir):
    names = ["clay", "sand", "MAT"]
    index = sum((F.when(F.array_contains("covariates", n), 2**i).otherwise(0) for i, n in enumerate(names)), F.lit(0))
    sets = rel.power_set(spark, names)
    return sets.select(F.coalesce(index, F.lit(0)).cast("long").alias("id"), F.coalesce(F.array_join("covariates", "+"), F.lit("")).alias("covariates"))


# value, part of the id, readable name
_MODELS = """('random_forest', 'random_forest', 'Random Forest'), ('plsr', 'plsr', 'Partial Least Squares'), ('cubist', 'cubist', 'Cubist'), ('xgboost', 'xgboost', 'XGBoost'), ('lightgbm', 'lightgbm', 'LightGBM'),
  ('elastic_net', 'elastic_net', 'Elastic Net'), ('svm_rbf', 'svm_rbf', 'Support Vector Machine (RBF)'), ('mars', 'mars', 'MARS'), ('mlp_nn', 'mlp_nn', 'Neural Network (MLP)')"""
_TRANSFORMS = "('log', 'Log', 'Logarithmic'), ('none', 'NoTrans', 'None'), ('sqrt', 'Sqrt', 'Square Root')"
_STEPS = """('raw', 'Raw', 'Raw Spectra'), ('sg', 'SG', 'Savitzky-Golay Smoothing'), ('snv', 'SNV', 'Standard Normal Variate'), ('deriv1', 'D1', 'First Derivative'), ('deriv2', 'D2', 'Second Derivative'),
  ('snv_deriv1', 'SNVD1', 'SNV + First Derivative'), ('snv_deriv2', 'SNVD2', 'SNV + Second Derivative')"""
_SELECTIONS = "('none', 'NoFeatSel', 'No Selection'), ('pca', 'PCA', 'Principal Component Analysis'), ('correlation', 'Corr', 'Correlation Filter'), ('boruta', 'Boruta', 'Boruta Algorithm'), ('cars', 'CARS', 'CARS Selection')"
_SETS = "('', 0, 'NoCovs', 'None'), ('clay', 1, 'clay', 'Clay Content'), ('MAT', 1, 'MAT', 'Mean Annual Temperature'), ('clay_MAT', 2, 'clay+MAT', 'Clay Content + Mean Annual Temperature')"
_GRID = f"""WITH g AS (
  SELECT m.v AS model, t.v AS transformation, p.v AS preprocessing, f.v AS feature_selection, c.v AS covs, c.n AS n,
         m.k || '_' || t.k || '_' || p.k || '_' || f.k || '_' || c.k || '_NoInteract' AS workflow_id, m.r AS mr, t.r AS tr, p.r AS pr, f.r AS fr, c.r AS cr
  FROM (VALUES {_MODELS}) m(v, k, r), (VALUES {_TRANSFORMS}) t(v, k, r), (VALUES {_STEPS}) p(v, k, r), (VALUES {_SELECTIONS}) f(v, k, r), (VALUES {_SETS}) c(v, n, k, r)
) """


def _configs(spark):
    models = [*schema.MODELS, "plsr"]  # a repeated value counts once
    return rel.create_configs(spark, models, schema.TRANSFORMATIONS, schema.PREPROCESSING, schema.FEATURE_SELECTIONS, ["clay"], ["MAT"])


@register("config_grid", _GRID + "SELECT printf('config_%04d', row_number() OVER (ORDER BY model, transformation, preprocessing, feature_selection, n, covs)) AS config_id, model, transformation, preprocessing, feature_selection, covs AS covariates FROM g")
def config_grid(spark, sf_dir):
    return _configs(spark).select("config_id", "model", "transformation", "preprocessing", "feature_selection", F.coalesce(F.array_join("covariates", "_"), F.lit("")).alias("covariates"))


@register("workflow_ids", _GRID + "SELECT workflow_id FROM g")
def workflow_ids(spark, sf_dir):
    return rel.with_workflow_id(_configs(spark)).select("workflow_id")


@register("workflow_names", _GRID + "SELECT workflow_id, mr AS model, tr AS transformation, pr AS preprocessing, fr AS feature_selection, cr AS covariates FROM g")
def workflow_names(spark, sf_dir):
    return workflow_ids(spark, sf_dir).select("workflow_id", text.parse_workflow_id("workflow_id").alias("p")).select("workflow_id", "p.*")


@register("back_transform", "SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, k, round(CASE k WHEN 'log' THEN exp(l_tax) WHEN 'sqrt' THEN l_tax * l_tax ELSE l_tax END, 6) AS pred FROM lineitem, (VALUES ('log'), ('sqrt'), ('none')) t(k)")
def back_transform(spark, sf_dir):
    kinds = spark.createDataFrame([("log",), ("sqrt",), ("none",)], "k string")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", F.col("l_tax").alias("pred"))
    return text.back_transform_predictions(rows.crossJoin(F.broadcast(kinds)), "k").withColumn("pred", r6("pred"))


@register("needs_back_transformation", "SELECT DISTINCT o_orderpriority, k, lower(k) IN ('log', 'sqrt') AS needed FROM orders, (VALUES ('log'), ('Sqrt'), ('none'), ('NoTrans'), ('NA')) t(k)")
def needs_back_transformation(spark, sf_dir):
    kinds = spark.createDataFrame([("log",), ("Sqrt",), ("none",), ("NoTrans",), ("NA",)], "k string")
    rows = table(spark, sf_dir, "orders").select("o_orderpriority").distinct()
    return rows.crossJoin(F.broadcast(kinds)).withColumn("needed", text.needs_back_transformation("k"))


@register("topn_by_metric", f"WITH {_PAIRS} SELECT l_returnflag, l_linestatus, round(sqrt(avg((t - e) * (t - e))), 6) AS rmse FROM p GROUP BY 1, 2 ORDER BY rmse, l_returnflag LIMIT 2")
def topn_by_metric(spark, sf_dir):
    wide = metrics.metrics_wide(_pairs(spark, sf_dir), "t", "e", ["l_returnflag", "l_linestatus"], ("rmse",))
    return rel.top_n(wide, "rmse", 2, "l_returnflag").withColumn("rmse", r6("rmse"))


@register("prune_rule", f"WITH {_PAIRS}, b AS (SELECT 100 * stddev_samp(t) / abs(avg(t)) AS base FROM p) SELECT l_returnflag, any_value(round(base, 6)) AS baseline, 100 * sqrt(avg((t - e) * (t - e))) / avg(t) > any_value(base) * .1 AS pruned FROM p, b GROUP BY 1")
def prune_rule(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    mean, sd = pairs.agg(F.avg("t"), F.stddev_samp("t")).first()
    wide = metrics.metrics_wide(pairs, "t", "e", ["l_returnflag"], ("rrmse",))
    return rel.prune_flags(wide, mean, sd, 0.1).select("l_returnflag", r6("baseline").alias("baseline"), "pruned")


@register("union_fill", "SELECT doc_id AS id, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic, CAST(NULL AS DOUBLE) AS label FROM labels UNION ALL SELECT vec_id, NULL, NULL, label::DOUBLE FROM embeddings")
def union_fill(spark, sf_dir):
    number = lambda c: F.col(c).cast("double").alias(c)
    a = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), number("quality"), number("toxic"))
    return rel.union_fill(a, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), number("label")))


_ORDER = "(c_custkey * 7919 + 307) % 10007"
_BINS = f"""WITH q AS (SELECT quantile_cont(c_acctbal, .25) a, quantile_cont(c_acctbal, .5) b, quantile_cont(c_acctbal, .75) c FROM customer),
n AS (SELECT c_custkey, CASE WHEN c_acctbal <= a THEN 'Q1' WHEN c_acctbal <= b THEN 'Q2' WHEN c_acctbal <= c THEN 'Q3' ELSE 'Q4' END AS bin FROM customer, q),
o AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {_ORDER}, c_custkey) AS k, count(*) OVER (PARTITION BY bin) AS n FROM n) """


@register("stratified_split", _BINS + "SELECT c_custkey, bin, CASE WHEN k <= floor(n * .8 + 1e-9) THEN 'train' ELSE 'test' END AS split FROM o")
def stratified_split(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return rel.stratified_split(rows, "c_acctbal", "c_custkey", 0.8, order=F.struct(F.expr(_ORDER), "c_custkey")).drop("c_acctbal")


@register("cv_folds", _BINS + "SELECT c_custkey, bin, ((k - 1) % 10)::INT AS fold FROM o")
def cv_folds(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return rel.folds(rows, "c_acctbal", "c_custkey", 10, order=F.struct(F.expr(_ORDER), "c_custkey")).drop("c_acctbal")


_NAMES = [c.split()[0] for c in schema.PROPERTY_SCHEMA.split(", ")]
_VALUES = ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in schema.SOIL_PROPERTIES)


@register("property_map", f"SELECT * FROM (VALUES {_VALUES}) t({', '.join(_NAMES)})")
def property_map(spark, sf_dir):
    return rel.property_map(spark).select(*_NAMES)


@register("cluster_members", "SELECT label, list_sort(list(vec_id)) AS members FROM embeddings GROUP BY 1")
def cluster_members(spark, sf_dir):
    return rel.cluster_members(table(spark, sf_dir, "embeddings"), "label", "vec_id")


@register("status_counts", "SELECT CASE o_orderstatus WHEN 'O' THEN 'success' WHEN 'F' THEN 'pruned' ELSE 'failed' END AS status, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    from bandweave.operators.runner import status_counts as counted

    status = F.when(F.col("o_orderstatus") == "O", "success").when(F.col("o_orderstatus") == "F", "pruned").otherwise("failed")
    return counted(table(spark, sf_dir, "orders").select(status.alias("status")))


@register("complete_cases", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL AND o_totalprice > 0 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1996-01-01'")
def complete_cases(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").dropna(subset=["o_totalprice", "o_custkey"])
    return rows.where((F.col("o_totalprice") > 0) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))).select("o_orderkey", "o_totalprice")
