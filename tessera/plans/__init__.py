"""Whole evaluations: families of metrics, their scores, and the command line."""
