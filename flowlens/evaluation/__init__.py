"""Evaluation of predictions and models."""
