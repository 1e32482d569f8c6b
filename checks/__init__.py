"""Registered queries and the independent SQL that checks them."""
