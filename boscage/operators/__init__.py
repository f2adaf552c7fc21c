"""Operators over point clouds, graphs and tree models."""
