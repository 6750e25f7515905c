"""Corvane: a PySpark-native engine for catalogues of binary assets and the measurements taken on them."""
