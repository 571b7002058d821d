"""Operators of a training-data pipeline: each reads whole tables and whole texts."""
