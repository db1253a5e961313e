"""Field-service dispatch, spectral cube, particle and model jobs on PySpark DataFrames."""
