"""Scoring of request streams."""
