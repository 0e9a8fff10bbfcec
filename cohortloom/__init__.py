"""Cohort building, point-in-time features and risk-score evaluation on Spark."""
