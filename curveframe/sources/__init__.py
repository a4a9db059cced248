"""Readers and writers for curve files, XML objects, frame tables and assets."""
