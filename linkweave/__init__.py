"""Spark-native contact-graph analytics: linkage, sparse graph transforms, clustering and scoring on DataFrames."""
