"""Functions: the byte formats (words, blocks, packing, frames, messages), schema text and rendering."""
