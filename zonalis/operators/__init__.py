"""Operators over tables of pages, lines and readings."""

from zonalis.operators.crops import against_twin, model_inputs, prepared, prepared_batch, rectified, straightened
from zonalis.operators.imaging import atlas_scorer, cut_pages, grey_pages, locate_pages, render_pages, score_pages
from zonalis.operators.payload import as_payload
from zonalis.operators.reading import against_truth, measured, missed, read_pages, report

__all__ = ["against_truth", "against_twin", "as_payload", "atlas_scorer", "cut_pages", "grey_pages", "locate_pages", "measured", "missed", "model_inputs", "prepared", "prepared_batch", "read_pages", "rectified", "render_pages", "report", "score_pages", "straightened"]
