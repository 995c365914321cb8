"""Readers for recordings and their side files."""
