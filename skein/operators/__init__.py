"""Operators over logical relations; every function takes and returns DataFrames."""
