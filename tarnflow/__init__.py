"""Flow routing, voxel graphs and training-data operators on Spark DataFrames."""
