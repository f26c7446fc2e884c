"""Spark-native integrity, temporal, graph and reconciliation operators over tables of typed resources."""
