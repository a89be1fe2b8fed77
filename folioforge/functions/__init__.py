"""Part of folioforge."""
