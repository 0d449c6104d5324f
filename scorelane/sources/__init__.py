"""Readers and writers of reference sets, indexes, requests and results."""
