"""Readers and writers: transcripts, annotation, corpus tables, manifests, feature tables and the trust registry."""
