"""Readers and writers. Parsers work on frames of text lines, so any text source can feed them."""
