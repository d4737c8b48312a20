"""cairn: a PySpark-native engine for evidence-style tables.

Operators take and return DataFrames; queries bind them to the driver tables.
"""
