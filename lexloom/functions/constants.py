"""Dimensions of the corpus. Fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LAWS = {
    "BV": ("101", "1999/404"),
    "ZGB": ("210", "24/233_245_233"),
    "OR": ("220", "27/317_321_377"),
    "ZPO": ("272", "2010/262"),
    "StGB": ("311.0", "54/757_781_799"),
    "StPO": ("312.0", "2010/267"),
    "SchKG": ("281.1", "11/529_488_529"),
    "VwVG": ("172.021", "1969/737_757_755"),
    "BGFA": ("935.61", "2002/153"),
}
PUBLISHED_DIRS = ("bv", "zgb", "or", "zpo", "stgb", "stpo", "schkg", "vwvg")
LAYERS = ("summary", "doctrine", "caselaw")
LAYER_LABELS = {"summary": "Overview", "doctrine": "Doctrine", "caselaw": "Case Law"}
LAYER_HEADINGS = {"summary": "Übersicht", "doctrine": "Doktrin", "caselaw": "Rechtsprechung"}
LANGS = ("de", "fr", "it", "en")
TRANSLATIONS = {"fr": "French", "it": "Italian", "en": "English"}
STATIC_PAGES = ("", "about", "methodology", "changelog")
CONFIDENCE = ("settled", "contested", "evolving")
AUTHOR_STATUS = ("draft", "reviewed", "contested")
AMENDMENTS = ("Eingefügt", "Fassung gemäss", "Aufgehoben", "Angenommen", "in der Fassung", "In Kraft", "Berichtigt")
MODELS = {"summary": "sonnet", "doctrine": "opus-thinking", "caselaw": "sonnet"}
THRESHOLDS = {"precision": 0.95, "concision": 0.90, "accessibility": 0.90, "relevance": 0.90, "academic_rigor": 0.95}


def laws(spark: SparkSession) -> DataFrame:
    """law, dir, sr_number, eli: nine rows, so a broadcast of it is bounded."""
    return spark.createDataFrame([(k, k.lower(), sr, eli) for k, (sr, eli) in LAWS.items()], "law string, dir string, sr_number string, eli string")


def langs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, x) for i, x in enumerate(LANGS)], "lang_pos int, lang string")
