"""Fixed values that results depend on: word lists, the sport catalog and alias tables."""
