"""punctaria.sources."""
