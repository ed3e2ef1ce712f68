"""Readers and writers: metadata, labels, manifests, sidecars, file inventories, experiment folders, reports."""
