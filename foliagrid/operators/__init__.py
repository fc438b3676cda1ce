"""Operators on points, tiles, cells and rasters; rasters are tables with a row for each cell that has a value."""
