"""Sources of the recipe-text engine."""
