"""Quernstone operators."""
