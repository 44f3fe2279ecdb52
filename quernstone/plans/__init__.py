"""Quernstone plans."""
