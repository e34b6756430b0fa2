"""Part of oxbow."""
