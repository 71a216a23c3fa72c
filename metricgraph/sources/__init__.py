"""Readers and writers of the graph files, and the domain tables derived from the driver's tables."""
