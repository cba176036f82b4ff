"""Detecting, localising and simulating drift in data and model performance, as DataFrame transformations."""
