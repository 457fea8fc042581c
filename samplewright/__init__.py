"""Sampling design, budgeted selection and evaluation on Spark DataFrames."""
