"""Streaming of the recipe-text engine."""
