"""punctaria.operators."""
