"""Functions of the recipe-text engine."""
