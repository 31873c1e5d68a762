"""Operators over tables of timed words, cards, spans and edits."""
