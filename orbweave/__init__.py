"""orbweave: geospatial proximity joins and metadata operators on Spark."""
