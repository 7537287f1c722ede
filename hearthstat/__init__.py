"""Weighted household-survey analytics as plain DataFrame-to-DataFrame functions on Spark."""
