"""Part of rillflow."""
