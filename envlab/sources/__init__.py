"""Readers. Every reader returns a lazy DataFrame; nothing is collected."""
