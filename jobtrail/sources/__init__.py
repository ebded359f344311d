"""Readers: messages, operational tables, replay."""
