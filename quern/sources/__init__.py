"""Readers, writers and the views that map tables onto the message model."""
