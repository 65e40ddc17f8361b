"""Column builders: pair keys, orientation classes, distances, directions."""
