"""Thresholds of the layout engine, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # text lines, in ems unless said otherwise
    word_gap: float = 0.25
    word_gap_inferred: float = 0.15
    negligible_advance: float = 0.05
    overlay_window: int = 8
    line_drift: float = 0.3
    least_drift: float = 0.5  # points
    # reading order
    gutter: float = 1.5
    tall_gutter: float = 0.9
    column_width: float = 5.0
    tall_region: float = 8.0
    row_gap: float = 1.0
    multiline_height: float = 1.8
    cut_depth: int = 24
    cut_items: int = 4
    # painted rules, points
    rule_thickness: float = 3.0
    rule_length: float = 4.0
    axis_tolerance: float = 0.5
    path_segments: int = 8192
    # ruled tables
    merge_tolerance: float = 2.0
    rule_span: float = 0.5
    boundaries: int = 3
    row_outlier: float = 3.0
    # borderless tables
    borderless_rows: int = 5
    borderless_columns: int = 4
    borderless_gap: float = 0.8
    band_outlier: float = 2.5
    spanning_rows: float = 0.6
    row_rejoin: float = 0.6
    occupancy: float = 0.4
    vote_support: float = 0.75
    vote_reach: float = 0.5
    table_width: int = 20_000
    inferred_confidence: float = 0.5
    # tables and blocks
    filled_cells: int = 4
    filled_share: float = 0.5
    background_share: float = 0.7
    structure_coverage: float = 0.8
    # verdicts
    needs_ocr_rate: float = 0.5
    degraded_rate: float = 1.0
    invisible_rate: float = 0.9
    least_text: int = 2
    image_page: float = 0.5
    image_page_little: int = 4
    image_page_sparse: int = 50
    # headings
    heading_ratio: float = 1.15
    heading_levels: int = 6
    size_bucket: float = 0.5
    pale: float = 0.85


PARAMS = Params()
