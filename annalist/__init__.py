"""Longitudinal-history analytics on PySpark: plan builders over DataFrames."""
