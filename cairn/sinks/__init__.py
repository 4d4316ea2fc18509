"""Writers of what an image holds."""
