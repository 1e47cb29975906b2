"""A repository as tables, and its maintenance."""
