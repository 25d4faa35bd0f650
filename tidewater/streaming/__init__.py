"""Variance filters over streams."""
