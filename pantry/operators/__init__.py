"""Operators of the recipe-text engine."""
