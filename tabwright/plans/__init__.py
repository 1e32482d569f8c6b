"""Fitted plans and the entry points that chain the operators."""
