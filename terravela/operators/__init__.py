"""Operators on grids, flow networks, vectors and the catalogue; all take and return DataFrames."""
