"""Part of embervane."""
