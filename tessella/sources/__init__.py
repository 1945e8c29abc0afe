"""Readers and writers: vectors, lists, models, stores and index folders."""
