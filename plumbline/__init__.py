"""Point-cloud, raster, line and polygon analytics on Spark DataFrames."""
