"""Curation of labelled corpora and evaluation of detectors, as Spark DataFrames."""
