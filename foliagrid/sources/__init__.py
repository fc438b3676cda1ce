"""Files in and out: point clouds, arrays, vectors, rasters, surveys, configuration."""
