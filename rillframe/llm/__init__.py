"""Operators for text and event data; nothing outside this subpackage imports it."""
