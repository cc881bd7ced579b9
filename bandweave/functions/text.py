"""Identifiers: file names into columns, configurations into workflow ids and back, readable names; back-transformation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The codes and readable names of the configuration's parts.
MODEL_NAMES = {
    "plsr": "Partial Least Squares",
    "random_forest": "Random Forest",
    "cubist": "Cubist",
    "xgboost": "XGBoost",
    "lightgbm": "LightGBM",
    "elastic_net": "Elastic Net",
    "svm_rbf": "Support Vector Machine (RBF)",
    "mars": "MARS",
    "mlp_nn": "Neural Network (MLP)",
}
TRANSFORMATION_CODES = {
    "none": "NoTrans",
    "no transformation": "NoTrans",
    "log": "Log",
    "log transformation": "Log",
    "sqrt": "Sqrt",
    "square root transformation": "Sqrt",
}
TRANSFORMATION_NAMES = {"none": "None", "notrans": "None", "sqrt": "Square Root", "log": "Logarithmic"}
PREPROCESSING_CODES = {
    "raw": "Raw",
    "snv": "SNV",
    "standard normal variate": "SNV",
    "sg": "SG",
    "savitzky-golay smoothing": "SG",
    "deriv1": "D1",
    "first derivative": "D1",
    "deriv2": "D2",
    "second derivative": "D2",
    "snv_deriv1": "SNVD1",
    "snv + first derivative": "SNVD1",
    "snv_deriv2": "SNVD2",
    "snv + second derivative": "SNVD2",
}
PREPROCESSING_NAMES = {
    "raw": "Raw Spectra",
    "sg": "Savitzky-Golay Smoothing",
    "snv": "Standard Normal Variate",
    "deriv1": "First Derivative",
    "d1": "First Derivative",
    "deriv2": "Second Derivative",
    "d2": "Second Derivative",
    "snv_deriv1": "SNV + First Derivative",
    "snvd1": "SNV + First Derivative",
    "snv_deriv2": "SNV + Second Derivative",
    "snvd2": "SNV + Second Derivative",
}
SELECTION_CODES = {
    "none": "NoFeatSel",
    "no selection": "NoFeatSel",
    "pca": "PCA",
    "principal component analysis": "PCA",
    "boruta": "Boruta",
    "boruta algorithm": "Boruta",
    "correlation": "Corr",
    "correlation filter": "Corr",
    "remove_correlated": "Corr",
    "cars": "CARS",
    "cars selection": "CARS",
    "vip": "VIP",
    "variable importance": "VIP",
    "rfe": "RFE",
    "recursive feature elimination": "RFE",
}
SELECTION_NAMES = {
    "none": "No Selection",
    "nofeatsel": "No Selection",
    "remove_correlated": "Correlation Filter",
    "correlation": "Correlation Filter",
    "corr": "Correlation Filter",
    "vip": "Variable Importance (VIP)",
    "rfe": "Recursive Feature Elimination",
    "boruta": "Boruta Algorithm",
    "cars": "CARS Selection",
    "shap": "SHAP Values",
    "pca": "Principal Component Analysis",
}
COVARIATE_NAMES = {
    "clay": "Clay Content",
    "sand": "Sand Content",
    "silt": "Silt Content",
    "ph": "pH",
    "pH": "pH",
    "phh2o": "pH (H2O)",
    "oc": "Organic Carbon",
    "ocd": "Organic Carbon Density",
    "n": "Nitrogen",
    "nitrogen": "Nitrogen",
    "cec": "CEC",
    "bdod": "Bulk Density",
    "MAT": "Mean Annual Temperature",
    "MAP": "Mean Annual Precipitation",
    "PET": "Potential Evapotranspiration",
    "AI": "Aridity Index",
    "GDD": "Growing Degree Days",
    "Precip_Seasonality": "Precipitation Seasonality",
    "elevation": "Elevation",
    "Elevation": "Elevation",
    "slope": "Slope",
    "aspect": "Aspect",
    "SoilGrids": "SoilGrids Data",
    "Temp": "Temperature",
    "Precip": "Precipitation",
    "Climate": "Climate Variables",
    "Soil": "Soil Properties",
    "Terrain": "Terrain Features",
    "All": "All Covariates",
    "NoCovs": "None",
}
#: Part of a file name -> column
NAME_PARTS = {"project": "Project", "sampleid": "Sample_ID", "fraction": "Fraction", "wellid": "Well_ID", "scanid": "Scan"}


def _as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in table.items() for v in pair]), key)


def parse_file_name(name: Column | str, layout: str, delimiter: str = "_", default_fraction: str = "GroundBulk") -> dict[str, Column]:
    """Columns of a file name that is split like its layout, for example "project_sampleid_fraction".

    An alphanumeric extension is dropped. A name with too few parts has the Sample_ID UNKNOWN and no other part; parts
    beyond the layout are ignored. Parts other than NAME_PARTS keep their own names. Fraction has a default.
    """
    stem = F.regexp_replace(_as_column(name), r"\.[A-Za-z0-9]+$", "")
    tokens = layout.lower().split(delimiter) if re.escape(delimiter) == delimiter else re.split(delimiter, layout.lower())
    parts = F.split(stem, delimiter)
    whole = F.size(parts) >= len(tokens)
    found: dict[str, Column] = {}
    for i, token in enumerate(tokens):
        column = NAME_PARTS.get(token, token)
        unknown = F.lit("UNKNOWN") if column == "Sample_ID" else F.lit(default_fraction) if column == "Fraction" else F.lit(None).cast("string")
        found[column] = F.when(whole, F.get(parts, F.lit(i))).otherwise(unknown)
    found.setdefault("Sample_ID", F.when(whole, stem).otherwise(F.lit("UNKNOWN")))
    found.setdefault("Fraction", F.lit(default_fraction))
    return found


def workflow_id(model, transformation, preprocessing, feature_selection, covariates, covariate_interactions) -> Column:
    """Code of a configuration; unknown transformations keep their name, other unknown parts are upper-cased."""
    t, p, s = (_as_column(x) for x in (transformation, preprocessing, feature_selection))
    covs = F.filter(F.coalesce(_as_column(covariates), F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != ""))
    parts = [
        _as_column(model),
        F.coalesce(_lookup(F.lower(t), TRANSFORMATION_CODES), t),
        F.coalesce(_lookup(F.lower(p), PREPROCESSING_CODES), F.upper(p)),
        F.coalesce(_lookup(F.lower(s), SELECTION_CODES), F.upper(s)),
        F.when(F.size(covs) > 0, F.array_join(covs, "+")).otherwise("NoCovs"),
        F.when(_as_column(covariate_interactions), "Interact").otherwise("NoInteract"),
    ]
    return F.regexp_replace(F.regexp_replace(F.concat_ws("_", *parts), "__", "_"), "_$", "")


def readable(kind: str, value: Column | str) -> Column:
    """Readable name of a model, preprocessing, transformation, feature_selection or covariate; NULL is Unknown."""
    tables = {"model": MODEL_NAMES, "preprocessing": PREPROCESSING_NAMES, "transformation": TRANSFORMATION_NAMES, "feature_selection": SELECTION_NAMES, "covariate": COVARIATE_NAMES}
    value = _as_column(value)
    key = value if kind in ("model", "covariate") else F.lower(value)
    return F.coalesce(_lookup(key, tables[kind]), value, F.lit(None if kind == "covariate" else "Unknown"))


def parse_workflow_id(value: Column | str) -> Column:
    """struct of readable parts of a workflow id; a part that is missing has the name of its default."""
    value = _as_column(value)
    models = "|".join(sorted(MODEL_NAMES, key=len, reverse=True))
    transformations = "NoTrans|Log|Sqrt|NA"
    preprocessings = "snv_deriv1|snv_deriv2|SNVD1|SNVD2|deriv1|deriv2|Raw|raw|SNV|snv|SG|sg|D1|D2|NA"
    selections = "remove_correlated|NoFeatSel|None|PCA|Boruta|CARS|Corr|VIP|RFE|vip|rfe|boruta|cars|NA"
    pattern = f"^({models})?(?:_?({transformations})(?=_|$))?(?:_({preprocessings})(?=_|$))?(?:_({selections})(?=_|$))?(?:_(.*?))?(?:_(?:No)?Interact)?$"
    part = lambda i: F.nullif(F.nullif(F.regexp_extract(value, pattern, i), F.lit("")), F.lit("NA"))
    names = F.filter(F.split(part(5), r"\+"), lambda c: (c != "NA") & (c != "") & (c != "NoCovs"))
    covariates = F.array_join(F.transform(names, lambda c: readable("covariate", c)), " + ")
    return F.struct(
        F.coalesce(readable("model", F.coalesce(part(1), F.lit("unknown")))).alias("model"),
        readable("transformation", F.coalesce(part(2), F.lit("NoTrans"))).alias("transformation"),
        readable("preprocessing", F.coalesce(part(3), F.lit("raw"))).alias("preprocessing"),
        readable("feature_selection", F.coalesce(part(4), F.lit("None"))).alias("feature_selection"),
        F.when(F.size(names) > 0, covariates).otherwise("None").alias("covariates"),
    )


def needs_back_transformation(transformation: Column | str) -> Column:
    value = F.lower(_as_column(transformation))
    return F.coalesce(~value.isin("none", "notrans", "na", ""), F.lit(False))


def back_transform(prediction: Column | str, transformation: Column | str, clamp: bool = False) -> Column:
    """Predictions on the response's own scale; clamp sets negative square-root predictions to zero before squaring."""
    x, kind = _as_column(prediction), F.lower(_as_column(transformation))
    root = F.greatest(x, F.lit(0.0)) if clamp else x
    root = F.when(x.isNotNull(), root)
    return F.when(kind == "log", F.exp(x)).when(kind == "sqrt", root * root).otherwise(x)


def forward_transform(response: Column | str, transformation: Column | str) -> Column:
    """The response on the model's scale, for training rows only; NULL where the transform is undefined."""
    x, kind = _as_column(response), F.lower(_as_column(transformation))
    return F.when(kind == "log", F.when(x > 0, F.ln(x))).when(kind == "sqrt", F.when(x >= 0, F.sqrt(x))).otherwise(x)


def back_transform_predictions(df: DataFrame, transformation: Column | str, columns: tuple[str, ...] = ("pred",), clamp: bool = False) -> DataFrame:
    """Long predictions (folds or last fit) with the columns back on the response's scale."""
    return df.withColumns({c: back_transform(c, transformation, clamp) for c in columns})


def legacy_back_transform(id_column: Column | str, prediction: Column | str) -> Column:
    """By the workflow id: Log -> exp, Sqrt -> square, else as it is."""
    ids, x = _as_column(id_column), _as_column(prediction)
    return F.when(ids.rlike("(?i)log"), F.exp(x)).when(ids.rlike("(?i)sqrt"), x * x).otherwise(x)
