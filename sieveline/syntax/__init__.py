"""Syntax trees of source texts and queries over them."""
