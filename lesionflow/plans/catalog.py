"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from . import catalog_audit, catalog_cohort, catalog_components, catalog_files, catalog_more, catalog_reports, catalog_rule, catalog_ruler, catalog_text, catalog_visits, catalog_voxel, catalog_worksheet

PARTS = (catalog_rule, catalog_voxel, catalog_cohort, catalog_more, catalog_text, catalog_reports, catalog_ruler, catalog_visits, catalog_components, catalog_audit, catalog_worksheet, catalog_files)
QUERIES = {k: v for part in PARTS for k, v in part.QUERIES.items()}
ORACLE = {k: v for part in PARTS for k, v in part.ORACLE.items()}
