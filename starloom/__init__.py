"""Clustering of particle snapshots and analysis of how the clusters evolve, on Spark."""
