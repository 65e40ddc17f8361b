"""Operators over links, graphs, scaffolds and scores."""
