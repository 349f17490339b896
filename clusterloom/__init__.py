"""Describe, label and measure document clusters with Spark DataFrames."""
