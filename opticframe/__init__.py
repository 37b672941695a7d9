"""A Spark-native engine for visual-feature data: descriptors, vectors, pixel grids and frame sequences as DataFrames."""
