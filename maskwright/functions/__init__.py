"""Subpackage of maskwright."""
