"""Scalar column functions: names, casts, JSON payloads and templates."""
