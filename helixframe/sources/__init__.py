"""Readers and writers of contig, link, bundle, scaffold and mask files."""
