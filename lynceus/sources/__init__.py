"""Readers, message decoders and report writers."""
