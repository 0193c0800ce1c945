"""A Spark-native graph analytics engine: every operator is a function of DataFrames."""
