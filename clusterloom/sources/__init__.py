"""Readers and writers of corpora, vectors, sweeps and scores."""
