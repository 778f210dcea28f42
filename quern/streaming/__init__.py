"""Ordered chunk streams, sessions and live views."""
