"""Operators on image series, masks and features: DataFrame in, DataFrame out."""
