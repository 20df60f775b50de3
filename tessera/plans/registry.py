"""All registered queries, by name, and the operator inventory each one exercises.

``COVERAGE`` maps every registered query to the SURVEY section 2 operator
ids it runs on the driver tables; ``LIBRARY_ONLY`` lists operators that act
on files or inline frames (workbooks, CSV/JSON/GeoJSON releases, sinks,
manifests) and are covered by the test suite instead of a registered query.
"""

from __future__ import annotations

from . import briefing, briefing_sql, extended, extended_sql, oracle, targets, testdata

QUERIES = dict(testdata.Q) | extended.Q | targets.Q | briefing.Q
SQL = dict(oracle.SQL) | extended_sql.SQL | targets.SQL | briefing_sql.SQL

COVERAGE: dict[str, list[str]] = {
    "region_supply_by_fy": ["P1", "X4", "J8", "A1", "B2"],
    "latest_fy_region_wide": ["P2", "A17", "T25", "W2"],
    "coerce_suppressed": ["X1", "X2", "X3"],
    "geo_level_case": ["X4", "X5", "X6", "X7"],
    "period_labels_sorted": ["P1", "P2", "P10"],
    "month_label_parse": ["P3", "P4", "P5", "P6", "P7", "P8", "P9"],
    "annual_last_and_mean": ["P11", "P12", "Y1"],
    "melt_measures": ["T4", "T5"],
    "melt_two_blocks": ["T4", "T11"],
    "year_property_melt": ["T12"],
    "pivot_measures": ["T24", "T26"],
    "band_share_abc": ["A11", "A12", "J11"],
    "la_rankings": ["J19", "X9", "J7", "W1", "B4"],
    "market_snapshot_la": ["J1", "B8", "T24", "A7", "B7"],
    "market_snapshot_region": ["J2", "J10", "B9", "A17", "W4"],
    "supply_fuel_join": ["J3", "K5", "B3"],
    "join_report": ["J17", "B3"],
    "ratio_common_year": ["K6", "J4", "B6", "B7"],
    "horizon_deltas": ["A19", "J15", "A7", "B12", "P13", "P14"],
    "entry_pressure": ["A20", "A7", "B13"],
    "region_change_top": ["A18", "A21", "A14", "P13", "P14"],
    "index_rebased": ["W5", "W6", "J16", "B15"],
    "overlap_growth": ["W4", "J5", "B10"],
    "spread_12m": ["W7", "J5"],
    "rates_per_1000": ["B21", "B22", "A2", "A8", "J10", "X9"],
    "supply_balance": ["B20", "A14", "X9"],
    "quantile_bins": ["W12"],
    "metric_kpis": ["A8", "A13"],
    "top_bottom": ["K1", "K2"],
    "paged_filtered_read": ["S5", "S6", "F1", "F2", "F3", "F4", "F11", "K4", "B30"],
    "semi_filter": ["J18"],
    "missing_inputs": ["K7", "S20"],
    "json_props": [],
    "header_split_family": ["T6", "T7", "T8", "T9", "T10", "T15", "T17", "T18"],
    "year_columns_melt": ["T13", "T4"],
    "metric_melt": ["T20", "T21", "T27", "T28", "T29"],
    "fills_and_filters": ["F5", "F6", "F7", "F8", "X8", "X10", "X11", "X13", "X14", "X15", "X16", "P15"],
    "aggregate_family": ["A2", "A3", "A4", "A5", "A6", "A9", "A14", "A15", "A16", "A22"],
    "latest_rows": ["W3"],
    "latest_period_rows": ["W2", "B26"],
    "dedup_first": ["W13", "J9"],
    "lag_family": ["W8", "W9", "W14"],
    "yoy_last_two": ["W11"],
    "leaders_trend": ["K1", "K3", "B14", "B28"],
    "line_by_year": ["B31"],
    "distinct_dims": ["K8"],
    "region_context_joins": ["J6", "J12", "J13", "J14", "J16", "P12", "B25"],
    "affordability_compare": ["B24", "P3", "P8", "K5", "K6"],
    "population_by_la": ["B1", "A2"],
    "mapped_metric": ["B23", "W12", "A8", "K2"],
    "findings": ["B17"],
    "summary_numbers": ["B19", "B27"],
    "series_catalog": ["Y1", "Y2", "Y18", "P15"],
    "backtest_plan": ["X13"],
    "seasonal_naive_backtest": ["Y3", "Y4", "Y5", "Y8", "Y10", "Y11", "Y12", "Y13", "Y14", "Y17", "W10", "A10"],
    "prob_bands": ["W10", "Y11", "Y15"],
    "classifier_metrics": ["M18", "M21"],
    "buy_vs_rent_spread": ["B11", "W6"],
    "national_ratio_endpoints": ["B16"],
    "narrative_panels": ["B29", "X8", "K1", "J13"],
    "briefing_sections": ["B18"],
    # model fits: rows-only checks (no SQL statement for a fitted model)
    "lagged_gbt": ["Y9", "W8", "W14"],
    "forward_forecasts": ["Y15", "Y20"],
    "fold_assignment": ["M3"],
    "fold_metrics": ["M4"],
    "scenario_shocks": ["M10", "A16"],
    "group_kfold_elastic_net": ["M1", "M3", "M4"],
    "group_kfold_gbt": ["M2", "M3", "M4"],
    "kmeans_embeddings": ["M5", "M7", "M9"],
    "pca_2d": ["M8"],
    "bisecting": ["M6"],
    "scenario_table": ["M10", "A16"],
    "playbook_scoreboard": ["M11", "M12", "M13", "M14", "M15", "M16", "M17", "M18", "M19", "M20", "S9", "X14", "A15"],
} | extended.COVERAGE | targets.COVERAGE | briefing.COVERAGE

# Operators on files and inline frames, covered by tests/test_sources.py and tests/test_tidy_and_ops.py.
LIBRARY_ONLY: dict[str, str] = {
    "S1": "sources.workbook.read_cells", "S2": "sources.workbook.sheet_frame(header_rows=2)",
    "S3": "sources.files.read_census_csv", "S4": "sources.files.read_rents_csv", "S7": "sources.files.read_lookup",
    "S8": "sources.files.read_reports", "S9": "sources.files.union_predictions", "S10": "sources.files.read_geojson / sources.files.geojson_bounds",
    "S11": "sources.sinks.write_tidy", "S12": "sources.sinks.write_csv_copy", "S13": "sources.sinks.bounded_export",
    "S14": "sources.sinks.publish_snapshot", "S15": "sources.sinks.publish_backtest", "S16": "sources.manifest.file_manifest",
    "S17": "sources.manifest.registry_snapshot", "S18": "streaming.incremental.load_changed_releases",
    "S19": "sources.manifest.fingerprint", "S20": "sources.manifest.missing_inputs",
    "T19": "plans.sheets.price_explorer", "B5": "plans.sheets.latest_median_price",
    "F10": "sources.catalog.read_page", "X12": "sources.sinks.json_rows",
    "T1": "operators.tidy.drop_empty", "T2": "operators.tidy.clean_wide_la", "T3": "operators.tidy.assert_headers",
    "T14": "operators.tidy.rename_positional", "T16": "operators.tidy.unique_slugs", "T22": "sources.files.rents_contract",
    "T23": "sources.workbook.workbook_family", "F9": "operators.models.numeric_features",
    "Y16": "sources.reports.pick_models", "Y19": "sources.reports.browser_summary",
}

# Operators of the inventory that are not built, and why.
NOT_BUILT: dict[str, str] = {
    "Y6": "seasonal ARIMA: a solver library of its own behind one task; smoothing and the baselines take its place",
    "Y7": "order search of the seasonal ARIMA",
}
