"""Resumable and at-most-once processing."""
