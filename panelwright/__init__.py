"""Panel-data and event-study operators for Spark DataFrames."""

import os

# Matrices on the driver and in tasks are small: one BLAS thread per process,
# set before numpy is first imported (a value that is already set stays).
for _name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
