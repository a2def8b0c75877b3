"""Readers of image folders and label files."""
