"""Offer linkage and price analytics as Spark DataFrame operators."""
