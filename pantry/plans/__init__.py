"""Plans of the recipe-text engine."""
