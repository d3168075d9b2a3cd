"""Readers and writers: captures, derived frames, polling device."""
