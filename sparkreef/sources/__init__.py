"""Readers and writers: feeds, catalogs, binary headers, text registries, exposition, artifacts."""
