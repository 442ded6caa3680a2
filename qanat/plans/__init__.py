"""Whole jobs: the batch, training and scoring, and the queries over the driver's tables."""
