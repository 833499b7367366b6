"""Turns, planners and graph traces over the search engine."""
