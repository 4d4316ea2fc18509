"""Folders of images as streams."""
