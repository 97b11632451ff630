"""Micro-batch versions."""
