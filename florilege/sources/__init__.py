"""Readers and writers of the record formats the engine knows."""
