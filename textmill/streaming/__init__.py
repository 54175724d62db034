"""Stateless text functions on streams."""
