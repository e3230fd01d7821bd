"""Operators on count experiments."""
