"""Operators on points, rasters, lines, boxes and solids."""
