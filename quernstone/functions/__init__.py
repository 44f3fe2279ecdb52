"""Quernstone functions."""
