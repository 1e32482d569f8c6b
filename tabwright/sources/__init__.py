"""Readers, writers, file inventories and saved runs."""
