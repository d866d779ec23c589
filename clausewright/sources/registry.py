"""The fixed list of documents to ingest."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.schema import SOURCE_SCHEMA

# Id, title, url, type, jurisdiction, instrument, year, in force, confidence, verbatim.
SOURCES = (
    ("pda_2000_overview", "Planning and Development Act 2000 — Overview",
     "https://www.irishstatutebook.ie/eli/2000/act/30/enacted/en/html",
     "primary_act", "national", "", 2000, dt.date(2000, 11, 28), "high", True),
    ("pda_2024_overview", "Planning and Development Act 2024",
     "https://www.irishstatutebook.ie/eli/2024/act/34/enacted/en/html",
     "primary_act", "national", "", 2024, dt.date(2024, 10, 17), "high", True),
    ("pdr_2001_schedule2",
     "Planning and Development Regulations 2001 — Schedule 2 (Exempted Development Classes)",
     "https://www.irishstatutebook.ie/eli/2001/si/600/made/en/print",
     "exemption_schedule", "national", "S.I. No. 600 of 2001", 2001, dt.date(2001, 10, 1), "high", True),
    ("exemption_solar_2022",
     "Planning and Development (Exempted Development) (No. 3) Regulations 2022 — Class 20F Solar",
     "https://www.irishstatutebook.ie/eli/2022/si/493/made/en/print",
     "secondary_si", "national", "S.I. No. 493 of 2022", 2022, dt.date(2022, 9, 15), "high", True),
    ("npf_2040", "National Planning Framework — Project Ireland 2040",
     "https://www.npf.ie/wp-content/uploads/Project-Ireland-2040-NPF.pdf",
     "national_policy", "national", "", 2018, dt.date(2018, 2, 16), "high", False),
    ("guidelines_rural_housing", "Sustainable Rural Housing Guidelines for Planning Authorities (DHLGH 2005)",
     "https://www.gov.ie/pdf/?file=https://assets.gov.ie/114242/52001fa8-a7f0-423c-9964-b17c85e05de4.pdf",
     "ministerial_guide", "national", "", 2005, dt.date(2005, 4, 1), "medium", False),
    ("schedule2_part1_seed",
     "Planning and Development Regulations 2001 — Schedule 2 Part 1 Classes 1-7 (Exempted Development)",
     "local://schedule2_part1_classes1to7_seed.txt",
     "exemption_schedule", "national", "S.I. No. 600 of 2001", 2001, dt.date(2002, 3, 11), "high", True),
    ("dublin_city_devplan_2022", "Dublin City Development Plan 2022-2028 — Written Statement",
     "local://dublin_city_devplan_2022.pdf",
     "council_devplan", "dublin_city", "", 2022, dt.date(2022, 12, 14), "high", True),
    ("citizens_info_planning", "Planning Permission — Citizens Information",
     "https://www.citizensinformation.ie/en/housing/planning-permission/planning-permission/",
     "ministerial_guide", "national", "", 2024, dt.date(2024, 1, 1), "medium", False),
    ("citizens_info_exempted", "Exempted Development — Citizens Information",
     "https://www.citizensinformation.ie/en/housing/planning-permission/exempted-development/",
     "exemption_schedule", "national", "", 2024, dt.date(2024, 1, 1), "medium", False),
    ("citizens_info_appeal", "Appealing a Planning Decision — Citizens Information",
     "https://www.citizensinformation.ie/en/housing/planning-permission/appealing-planning-permission-decision/",
     "ministerial_guide", "national", "", 2024, dt.date(2024, 1, 1), "medium", False),
)


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, SOURCE_SCHEMA)


def find_source(sources: DataFrame, source_id: str) -> DataFrame:
    """The source with this id, or no row."""
    return sources.where(F.col("id") == source_id)
