"""Registered queries: the operators run on whole tables."""
