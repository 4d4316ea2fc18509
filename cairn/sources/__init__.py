"""Where images are read from, and how their bytes are decoded."""
