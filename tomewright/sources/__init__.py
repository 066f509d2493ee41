"""Readers and writers: text files, XML metadata, stored artifacts."""
