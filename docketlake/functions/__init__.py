"""Column functions: tags, places, text matches, fixed values."""
