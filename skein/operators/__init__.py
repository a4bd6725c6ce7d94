"""Named DataFrame operators."""
