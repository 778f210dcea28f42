"""Relational operators over the message model: listing, threads, people, changes, history."""
