"""Proxima: density and graph clustering of vectors and documents, Spark-first.

Public functions map DataFrames to DataFrames; see the subpackages
``functions``, ``operators``, ``sources``, ``plans`` and ``streaming``.
"""
