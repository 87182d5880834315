"""Composed jobs: feature frame, model training, gap filling, evaluation."""
