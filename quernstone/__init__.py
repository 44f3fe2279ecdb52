"""Quernstone: retrieval and corpus analytics over text collections, written as Spark DataFrame operators."""
