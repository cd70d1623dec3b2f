"""Readers and writers of lakes, ground truth, vectors and results."""
