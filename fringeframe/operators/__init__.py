"""Operators over catalogs, spectra, images, predictions, calibrations and detections."""
