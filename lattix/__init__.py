"""Table-level operators for catalogs of described, tagged and scored items, on Spark DataFrames."""
