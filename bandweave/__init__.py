"""bandweave: a Spark-native engine for spectra held as array columns and for model search over them."""

import os

# One thread for BLAS in the driver and each Python worker, unless it is set otherwise: Spark's tasks are the parallelism.
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_name, "1")

__version__ = "0.1.0"
