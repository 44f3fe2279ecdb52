"""Quernstone sources."""
