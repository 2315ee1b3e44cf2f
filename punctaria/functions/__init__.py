"""punctaria.functions."""
