"""Governance of autonomous operations."""
