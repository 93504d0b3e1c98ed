"""Vocabularies, text and id files."""
