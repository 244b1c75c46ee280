"""Operators for preparing large text corpora, each usable on its own."""
