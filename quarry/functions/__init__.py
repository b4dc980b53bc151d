"""Expressions, filters and column scoping."""
