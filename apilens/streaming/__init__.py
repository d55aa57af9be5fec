"""Continuous scanning of arriving documents."""
