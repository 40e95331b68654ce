"""Writers for gridded products and the geocode cache."""
