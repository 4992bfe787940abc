"""Operators over the message table and over catalog tables."""
