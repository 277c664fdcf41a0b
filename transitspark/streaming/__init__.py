"""Streams of cadences."""
