"""Dimension values and the small tables built from them.

Everything under "FIXED VALUES" must equal what the tracked pipeline uses,
or scores, region mapping and sentiment would differ.  They are plain
constants; the DataFrame helpers below turn them into tiny tables (a few
dozen rows at most) that are safe to broadcast because their size is fixed
by this file, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the tracked pipeline exactly)
# ---------------------------------------------------------------------------

# Feed registry: source name -> feed url, in registry order.
FEEDS = [
    ("Ericsson", "https://www.ericsson.com/en/blog/rss"),
    ("Nokia", "https://www.nokia.com/newsroom/feed/en-us/"),
    ("Thales", "https://www.thalesgroup.com/en/rss.xml"),
    ("NEC Global", "https://www.nec.com/en/press/rss.xml"),
    ("MDPI Engineering", "https://www.mdpi.com/rss"),
    ("IEEE Spectrum", "https://spectrum.ieee.org/feeds/feed.rss"),
    ("ArXiv CS Networking", "https://export.arxiv.org/rss/cs.NI"),
    ("ETRI Journal", "https://onlinelibrary.wiley.com/feed/22337326/most-recent"),
    ("Next G Alliance", "https://www.nextgalliance.org/feed/"),
    ("SNS JU", "https://smart-networks.europa.eu/feed/"),
    ("GSMA Newsroom", "https://www.gsma.com/newsroom/feed/"),
    ("Samsung Newsroom", "https://news.samsung.com/global/feed"),
    ("SK Telecom News", "https://news.sktelecom.com/feed"),
    ("6GWorld", "https://www.6gworld.com/feed/"),
    ("RCR Wireless", "https://www.rcrwireless.com/feed"),
    ("Fierce Wireless", "https://www.fiercewireless.com/rss/xml"),
    ("Mobile World Live", "https://www.mobileworldlive.com/feed/"),
    ("Light Reading", "https://www.lightreading.com/rss.xml"),
    ("ZDNet 5G", "https://www.zdnet.com/topic/5g/rss.xml"),
]

# Sources whose entries skip the keyword threshold (empty in the tracked config).
SOURCE_LANGUAGE: dict[str, str] = {}

# Keyword weights.  English keywords are matched on lower-cased text,
# the multilingual ones on the raw text.
HIGH_PRIORITY = ["IMT-2030", "AI-native", "terahertz", "6G"]
MEDIUM_PRIORITY = ["radio spectrum", "6G architecture", "Release 21", "millimeter wave", "sub-THz"]
HIGH_PRIORITY_INTL = ["第六代移动", "六代移动通信", "6세대", "第6世代", "第六世代"]
MEDIUM_PRIORITY_INTL = ["移动通信", "이동통신", "移動通信"]
HIGH_WEIGHT = 3
MEDIUM_WEIGHT = 2
RELEVANCE_THRESHOLD = 2

# Canonical regions in tie-break order, and alias spellings (lower-case keys).
CANONICAL_REGIONS = ["US", "EU", "China", "Japan", "Korea", "India"]
# Order used by the regional-leader query for ties.
LEADER_ORDER = ["US", "China", "EU", "Japan", "Korea", "India"]
REGION_ALIASES = {
    "south korea": "Korea",
    "republic of korea": "Korea",
    "s. korea": "Korea",
    "european union": "EU",
    "europe": "EU",
    "eu27": "EU",
    "united states": "US",
    "united states of america": "US",
    "usa": "US",
    "u.s.": "US",
    "u.s.a.": "US",
    "america": "US",
    "peoples republic of china": "China",
    "people's republic of china": "China",
    "prc": "China",
    "mainland china": "China",
}
REGION_FLAGS = {
    "US": "🇺🇸", "EU": "🇪🇺", "China": "🇨🇳", "Japan": "🇯🇵", "Korea": "🇰🇷", "India": "🇮🇳",
}
DEFAULT_FLAG = "🌍"

# Impact dimensions of the profile, in display order, with radar labels.
DIMENSIONS = [
    "research_intensity",
    "standardization_influence",
    "industrial_deployment",
    "spectrum_policy_signal",
    "ecosystem_maturity",
]
DIMENSION_LABELS = ["Research", "Standardization", "Deployment", "Spectrum", "Ecosystem"]

# Retention parameters.
LOOKBACK_DAYS = 30
CACHE_TTL_DAYS = 180
RECENT_TTL_DAYS = 90
MAX_RECENT_ARTICLES = 50
MAX_TOPIC_LENGTH = 100
SUMMARY_CUT = 200

# Meeting-report vocabularies.
TDOC_PREFIXES = ["R1", "R2", "R3", "R4", "S2", "S6"]
AGREEMENT_KEYWORDS = ["agreed:", "decision:", "conclusion:", "way forward:", "agreement:", "decided:"]
SENTIMENT_POSITIVE = ["agreed", "approved", "accepted", "confirmed", "decision"]
SENTIMENT_NEUTRAL = ["further study needed", "ffs", "for further study", "to be studied"]
SENTIMENT_NEGATIVE = ["postponed", "rejected", "not agreed", "no consensus", "delayed"]
# Dates of a report, tried in this order without regard to case.
DATE_PATTERNS = [
    r"(\d{1,2}[-/]\d{1,2}[-/]\d{4})",
    r"(\d{4}[-/]\d{1,2}[-/]\d{1,2})",
    r"((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4})",
    r"(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4})",
]

# Work-plan vocabularies.
WORK_ITEM_SHEET_NAMES = ["Work Items", "Status Report", "WI Status", "Work Plan", "Release 21", "Rel-21"]
HEADER_MARKERS = ["work item", "wi", "status", "release"]
COLUMN_KEYWORDS = {
    "name": ["work item", "wi", "acronym", "name", "unique_id"],
    "status": ["status", "state", "completion"],
    "release": ["release", "rel", "target release"],
    "working_group": ["wg", "working group", "group", "tsg", "resource_names"],
}
COMPLETED_WORDS = ["complete", "approved", "finished", "100%"]
POSTPONED_WORDS = ["postpone", "delay", "suspend"]
TARGET_RELEASE = "Rel-21"
RELEASE_21_MARKERS = ["21", "rel-21", "rel21", "release 21"]

# Fetch-log vocabularies.
BLOCK_PHRASES = [
    "Access Denied",
    "Attention Required",
    "Cloudflare",
    "Ray ID:",
    "captcha",
    "Please verify you are a human",
    "blocked",
]
FEED_LINK_TYPES = ["application/rss+xml", "application/atom+xml", "application/xml", "text/xml"]

# Profile flag strings that count as true.
TRUE_STRINGS = ["1", "true", "yes"]

# ---------------------------------------------------------------------------
# Small dimension tables
# ---------------------------------------------------------------------------


def feeds_df(spark: SparkSession) -> DataFrame:
    rows = [(name, url, i) for i, (name, url) in enumerate(FEEDS)]
    return spark.createDataFrame(rows, "source string, url string, feed_ord int")


def source_language_df(spark: SparkSession, mapping: dict[str, str] | None = None) -> DataFrame:
    mapping = SOURCE_LANGUAGE if mapping is None else mapping
    return spark.createDataFrame(list(mapping.items()), "source string, language string")


def keywords_df(spark: SparkSession) -> DataFrame:
    rows = (
        [(k, HIGH_WEIGHT, False) for k in HIGH_PRIORITY]
        + [(k, MEDIUM_WEIGHT, False) for k in MEDIUM_PRIORITY]
        + [(k, HIGH_WEIGHT, True) for k in HIGH_PRIORITY_INTL]
        + [(k, MEDIUM_WEIGHT, True) for k in MEDIUM_PRIORITY_INTL]
    )
    return spark.createDataFrame(rows, "keyword string, weight int, case_sensitive boolean")


def regions_df(spark: SparkSession) -> DataFrame:
    rows = [(r, i, LEADER_ORDER.index(r), REGION_FLAGS[r]) for i, r in enumerate(CANONICAL_REGIONS)]
    return spark.createDataFrame(rows, "region string, region_ord int, leader_ord int, flag string")


def region_alias_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGION_ALIASES.items()), "alias string, region string")


KEYWORD_SCHEMA = T.StructType(
    [
        T.StructField("keyword", T.StringType()),
        T.StructField("weight", T.IntegerType()),
        T.StructField("case_sensitive", T.BooleanType()),
    ]
)
