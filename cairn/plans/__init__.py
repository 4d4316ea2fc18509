"""Views of an image that operators are applied to."""
