"""Readers and writers of the formats that evidence comes in."""
