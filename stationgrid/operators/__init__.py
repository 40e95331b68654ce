"""DataFrame operators: joins, neighbourhoods, rasters, features, splits, scores."""
