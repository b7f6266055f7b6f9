"""Operators for training data made of text."""
