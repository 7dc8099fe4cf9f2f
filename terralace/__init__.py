"""terralace: spatio-temporal observation analytics expressed as PySpark plans."""
