"""Readers: typed tables, and the artifacts that corpus analytics starts from."""
