"""Point clouds to gridded vegetation indicators and land-cover classes, as Spark plans."""
