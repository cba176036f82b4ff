"""Detectors, partitioners, ensembles and injectors."""
