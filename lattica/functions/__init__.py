"""Part of the lattica package."""
