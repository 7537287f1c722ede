"""Columns that the stages of the corpus pipeline hand on."""

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]
