"""Vellumite: rich documents as Spark tables."""
