"""Fixed names and the schemas of configurations and results."""

from __future__ import annotations

from pyspark.sql import types as T

# What a configuration can hold.
MODELS = ("random_forest", "plsr", "cubist", "xgboost", "lightgbm", "elastic_net", "svm_rbf", "mars", "mlp_nn")
TRANSFORMATIONS = ("none", "log", "sqrt")
PREPROCESSING = ("raw", "sg", "snv", "deriv1", "deriv2", "snv_deriv1", "snv_deriv2")
FEATURE_SELECTIONS = ("none", "pca", "correlation", "boruta", "cars")
DEFAULT_GRID_SIZE, DEFAULT_BAYES_ITER, DEFAULT_CV_FOLDS, NO_IMPROVE_LIMIT, CORE_BUFFER = 10, 15, 10, 10, 2
# Covariates by kind, and other names under which they are known.
SOIL_COVARIATES = ("clay", "sand", "silt", "ph", "phh2o", "oc", "ocd", "n", "nitrogen", "cec", "bdod", "ca", "mg", "k", "na", "p", "fe", "al", "mn", "zn", "cu")
CLIMATE_COVARIATES = ("MAT", "MAP", "PET", "AI", "GDD", "Precip_Seasonality", "Temperature_Range", "Frost_Days")
SPATIAL_COVARIATES = ("elevation", "slope", "aspect", "twi", "curvature", "hillshade", "roughness")
SOIL_ALIASES = {
    "phh2o": "ph",
    "n": "total_nitrogen",
    "nitrogen": "total_nitrogen",
    "bdod": "bulk_density",
    "ca": "calcium",
    "mg": "magnesium",
    "k": "potassium",
    "na": "sodium",
    "p": "phosphorus",
    "fe": "iron_amorphous",
    "al": "aluminum_crystalline",
}
COORDINATE_COLUMNS = ("Lat", "Lon", "lat", "lon", "Latitude", "Longitude", "latitude", "longitude", "X", "Y", "x", "y")
# Soil property, analyte, description, unit and library column of each property.
SOIL_PROPERTIES = (
    ("clay", "Clay, iso 11277", "Clay content by particle size analysis", "g/kg", "clay.tot_usda.a334_w.pct"),
    ("sand", "Sand, Total, iso 11277", "Sand content by particle size analysis", "g/kg", "sand.tot_usda.c60_w.pct"),
    ("silt", "Silt, Total, iso 11277", "Silt content by particle size analysis", "g/kg", "silt.tot_usda.c62_w.pct"),
    ("ph", "pH, 1:1 Soil-Water Suspension, iso 10390", "Soil pH in water suspension", "unitless", "ph.h2o_usda.a268_index"),
    ("oc", "Organic_Carbon, iso 10694", "Organic carbon content", "g/kg", "oc_usda.c729_w.pct"),
    ("cec", "CEC, pH 7.0, iso 11260", "Cation exchange capacity at pH 7.0", "cmolc/kg", "cec_usda.a723_cmolc.kg"),
    ("bulk_density", "Bulk Density, iso 11272", "Soil bulk density", "g/cm³", "bd_usda.a4_g.cm3"),
    ("total_nitrogen", "Nitrogen, Total NCS, iso 11261", "Total nitrogen content", "g/kg", "n.tot_usda.a623_w.pct"),
    ("carbonate", "Carbonate, iso 10693", "Carbonate content", "g/kg", "caco3_usda.a54_w.pct"),
    ("phosphorus", "Phosphorus, Extractable, Mehlich3", "Plant-available phosphorus (Mehlich-3)", "mg/kg", "p.ext_usda.a1070_mg.kg"),
    ("potassium", "Potassium, Extractable, NH4OAc, 2M KCl displacement", "Exchangeable potassium", "cmolc/kg", "k.ext_usda.a725_cmolc.kg"),
    ("calcium", "Calcium, Extractable, NH4OAc", "Exchangeable calcium", "cmolc/kg", "ca.ext_usda.a722_cmolc.kg"),
    ("magnesium", "Magnesium, Extractable, NH4OAc, 2M KCl displacement", "Exchangeable magnesium", "cmolc/kg", "mg.ext_usda.a724_cmolc.kg"),
    ("sodium", "Sodium, Extractable, NH4OAc, 2M KCl displacement", "Exchangeable sodium", "cmolc/kg", "na.ext_usda.a726_cmolc.kg"),
    ("aluminum_crystalline", "Aluminum, Crystalline, Total Pedogenic Iron", "Crystalline aluminum content", "% mass", "al.dith_usda.a65_w.pct"),
    ("iron_amorphous", "Iron, Amorphous, Total Non-Crystalline Iron", "Amorphous iron content", "% mass", "fe.ox_usda.a60_w.pct"),
)
PROPERTY_SCHEMA = "property string, analyte string, description string, target_unit string, library_column string"
CONFIG_SCHEMA = "config_id string, model string, transformation string, preprocessing string, feature_selection string, covariates array<string>, covariate_interactions boolean"

_text, _double = T.StringType(), T.DoubleType()
RESULT_SCHEMA = T.StructType(
    [T.StructField(c, _text) for c in ("config_id", "workflow_id", "model", "transformation", "preprocessing", "feature_selection", "covariates")]
    + [T.StructField("covariate_interactions", T.BooleanType()), T.StructField("best_params", T.MapType(_text, _double))]
    + [T.StructField(c, _double) for c in ("rsq", "rmse", "rrmse", "rpd", "ccc", "mae", "grid_seconds", "bayes_seconds", "total_seconds")]
    + [T.StructField(c, _text) for c in ("status", "error_message", "error_stage", "error_class")]
    + [T.StructField("has_trace", T.BooleanType()), T.StructField("n_warnings", T.IntegerType()), T.StructField("warning_summary", _text)]
)
SPECTRA_METADATA = ("channel_used", "source", "spectra_type", "source_path", "wavenumbers")
