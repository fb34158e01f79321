"""Operators for training-data text: repair, normalisation, splitting, alignment, similarity, encoding, mixing, language."""
