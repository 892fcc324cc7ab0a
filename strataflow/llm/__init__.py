"""Operators for preparing large text corpora, each a function from DataFrames to a DataFrame.

Every operator takes the names of the columns it reads, selects only those, and names all it adds, so
that further input columns, whatever they are called, change nothing.
"""
