"""Registered queries, their stand-in views and the matching SQL."""
