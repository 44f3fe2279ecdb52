"""Quernstone streaming."""
