"""Composed plans: detection (flows -> alerts), feature pipeline, training."""
