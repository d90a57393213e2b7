"""Operators on text corpora: token counts, pieces, copies, credentials, packing, mixing, cut-off texts."""
