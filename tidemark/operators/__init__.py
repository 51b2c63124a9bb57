"""Operators over samples and events: DataFrame in, DataFrame out."""
