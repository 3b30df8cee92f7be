"""The reports, built from the operators. Every function takes and returns
DataFrames; ids, dates and labels are arguments."""
