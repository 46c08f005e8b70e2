"""Scoring rollouts as they arrive."""
