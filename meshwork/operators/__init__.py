"""Graph, search and update operators on DataFrames."""
