"""Fitted plans and models on streams."""
