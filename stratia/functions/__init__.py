"""Part of stratia."""
