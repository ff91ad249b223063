"""Scoring, monitoring and explanation of probability-of-default models on Spark."""
