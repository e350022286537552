"""spanwood: property-graph, text and search analytics as plain PySpark DataFrames."""
