"""Scene-data analytics on Spark: object trees, time-sampled properties, geometry and materials as DataFrames."""
