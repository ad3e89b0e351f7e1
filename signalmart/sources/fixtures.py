"""Input views derived from the driver's tables.

The generated prose holds none of the tracked keywords, so these views plant
feed entries, profiles, targets, terms, a seen cache, meeting reports and work
items by ``doc_id`` / ``o_orderkey`` arithmetic.  Each view is one narrow
projection over one scan (no join, no shuffle): products with small literal
lists are written as ``explode``/``inline`` of a literal array, not as joins.

The same definitions, in SQL, feed the DuckDB oracle (``plans/oracle.py``).
Texts are used whole (no prefixes), so every text operator sees full documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims, schemas
from ..functions import text, urls

AS_OF = "2024-06-30"
RUN_DATE = "2024-06-30"
LINK_BASE = "https://news.example.org/a/"
TARGETS = ["US", "EU", "China", "Japan", "South Korea", "India", "Mars"]
TITLES = [
    "6G deployment plans",
    "Release 21 update",
    "TERAHERTZ research",
    "Weather report",
    "6세대 이동통신 기술",
    "第6世代移動通信",
    "Radio",
    "16GB memory",
]
PROFILE_REGIONS = ["US", "EU", "China", "Japan", "Korea", "India", "South Korea", " usa ", "Other"]

def _doc() -> Column:
    return F.col("doc_id")



def _case(key: Column, values: list) -> Column:
    """``CASE key WHEN 0 THEN v0 WHEN 1 THEN v1 ... END`` over an integer key."""
    out = None
    for i, v in enumerate(values):
        out = F.when(key == i, F.lit(v)) if out is None else out.when(key == i, F.lit(v))
    return out


# -- column builders over a documents row -----------------------------------


def entry_columns() -> list:
    link_id = _doc() - F.when(_doc() % 10 == 9, 1).when(_doc() % 100 == 45, 20).otherwise(0)
    link = F.when(_doc() % 50 == 7, F.lit("")).otherwise(F.concat(F.lit(LINK_BASE), link_id.cast("string")))
    summary = F.concat(
        F.when(_doc() % 8 == 6, F.lit("spectrum ")).otherwise(F.lit("")),
        F.col("text"),
        F.when(_doc() % 5 == 0, F.lit(" IMT-2030 roadmap")).when(_doc() % 5 == 1, F.lit(" millimeter wave")).otherwise(F.lit("")),
    )
    published = F.when(_doc() % 11 == 0, F.lit(None).cast("timestamp")).otherwise(
        F.date_sub(F.lit(AS_OF).cast("date"), (_doc() % 60).cast("int")).cast("timestamp")
    )
    return [
        _doc().alias("entry_ord"),
        F.col("source"),
        F.substring("source", 4, 100).cast("int").alias("feed_ord"),
        F.col("lang"),
        link.alias("link"),
        _case(_doc() % 8, TITLES).alias("title"),
        summary.alias("summary"),
        published.alias("published"),
    ]


def dimension_values() -> dict:
    return {
        "research_intensity": ((_doc() * 3) % 6).cast("double"),
        "standardization_influence": ((_doc() * 5 + 1) % 6).cast("double"),
        "industrial_deployment": ((_doc() * 7 + 2) % 6).cast("double"),
        "spectrum_policy_signal": ((_doc() + 3) % 6).cast("double"),
        "ecosystem_maturity": ((_doc() * 11 + 4) % 6).cast("double"),
    }


def profile_columns() -> list:
    return [
        (_doc() % 17 != 0).alias("present"),
        F.when(_doc() % 7 == 0, F.lit(None).cast("boolean")).otherwise(_doc() % 5 != 0).alias("is_relevant"),
        _case(_doc() % 9, PROFILE_REGIONS).alias("region_raw"),
        (_doc() % 10 + 1).cast("double").alias("importance"),
        F.date_add(F.lit("2024-01-01").cast("date"), (_doc() % 182).cast("int")).cast("string").alias("date"),
    ] + [v.alias(k) for k, v in dimension_values().items()]


def target_scores() -> list:
    return [((_doc() * (k + 1) + k) % 6).cast("double") for k in range(len(TARGETS))]


def term_array() -> Column:
    return F.array(
        F.concat(F.lit("concept"), (_doc() % 13).cast("string")),
        F.concat(F.lit("concept"), ((_doc() * _doc()) % 29).cast("string")),
    )


def profile_struct(title: Column) -> Column:
    """Nested M3 profile of a document (fields as the enricher returns them)."""
    dv = dimension_values()
    terms = term_array()
    return F.struct(
        F.when(_doc() % 7 == 0, F.lit(None).cast("boolean")).otherwise(_doc() % 5 != 0).alias("is_6g_relevant"),
        _case(_doc() % 9, PROFILE_REGIONS).alias("source_region"),
        F.concat(F.lit("Profile: "), title).alias("summary"),
        (_doc() % 10 + 1).cast("double").alias("overall_6g_importance"),
        (_doc() % 10 + 1).cast("double").alias("impact_score"),
        terms.alias("6g_topics"),
        F.create_map(*[x for k in dims.DIMENSIONS for x in (F.lit(k), dv[k])]).alias("impact_dimensions"),
        F.lit("mid-term").alias("time_horizon"),
        F.map_from_arrays(F.array(*[F.lit(t) for t in TARGETS]), F.array(*target_scores())).alias("world_power_impact"),
        terms.alias("emerging_concepts"),
        terms.alias("key_evidence"),
        F.lit(None).cast(schemas.STD_CONTEXT).alias("standardization_context"),
    )


class Fixtures:
    """Lazily built views over ``sf_dir``; every attribute is a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def entries(self) -> DataFrame:
        """M1 feed entries."""
        return self.table("documents").select(*entry_columns())

    @property
    def profiles(self) -> DataFrame:
        """Flat M3 profile per document; ``present`` false = no profile."""
        return self.table("documents").select(_doc().alias("doc_id"), *profile_columns())

    @property
    def targets(self) -> DataFrame:
        """Long form of world_power_impact: (doc_id, target, score)."""
        pairs = F.array(*[F.struct(F.lit(t).alias("target"), s.alias("score")) for t, s in zip(TARGETS, target_scores())])
        return self.table("documents").select(_doc(), F.inline(pairs))

    @property
    def terms(self) -> DataFrame:
        """Long form of concepts / topics / evidence: (doc_id, pos, term)."""
        return self.table("documents").select(_doc(), F.posexplode(term_array()).alias("pos", "term"))

    @property
    def articles(self) -> DataFrame:
        """M2 articles (one per document) with the nested M3 profile; null profile when absent."""
        e = self.table("documents").select(*entry_columns(), *profile_columns()).withColumn("doc_id", F.col("entry_ord"))
        ai = F.when(F.col("present"), profile_struct(F.col("title")))
        return e.select(
            "entry_ord",
            "feed_ord",
            urls.url_hash("link").alias("article_id"),
            "source",
            "title",
            "link",
            text.relevance_score("title", "summary").alias("score"),
            ai.alias("ai_insights"),
            F.when(F.col("present"), F.col("region_raw")).otherwise(F.lit("Other")).alias("source_region"),
            "summary",
            "date",
            "published",
        )

    @property
    def seen(self) -> DataFrame:
        """M7 seen cache: every third document's link, with a processed date (some unparseable)."""
        d = self.table("documents").where(_doc() % 3 == 0)
        pd = F.when(_doc() % 30 == 0, F.lit("not-a-date")).otherwise(
            F.date_sub(F.lit(AS_OF).cast("date"), (_doc() % 365).cast("int")).cast("string")
        )
        url = F.concat(F.lit(LINK_BASE), F.col("doc_id").cast("string"))
        return d.select(urls.url_hash(url).alias("article_id"), url.alias("url"), pd.alias("processed_date"))

    @property
    def reports(self) -> DataFrame:
        """Meeting reports: whole document text plus a planted meeting sentence."""
        content = F.concat(
            F.col("text"),
            F.lit(". Meeting held in Berlin, Germany on "),
            F.date_add(F.lit("2024-01-01").cast("date"), (_doc() % 90).cast("int")).cast("string"),
            F.when(_doc() % 4 == 0, F.lit(". Agreed: use R1-2312345 and S2-2401234"))
            .when(_doc() % 4 == 1, F.lit(". The item was postponed, rejected"))
            .when(_doc() % 4 == 2, F.lit(". Not agreed, further study needed"))
            .otherwise(F.lit("")),
        )
        wg = _case(_doc() % 3, ["RAN1", "SA2", "RAN2"])
        return self.table("documents").select(_doc().alias("meeting_id"), wg.alias("working_group"), content.alias("content"))

    @property
    def work_items(self) -> DataFrame:
        """Work-plan rows as the remote reader returns them (source column names)."""
        k = F.col("o_orderkey")
        release = _case(k % 4, ["Rel-21", "Rel-20", "release 21", "Rel-21"])
        wg = F.when(k % 19 == 0, F.lit("nan")).otherwise(F.substring("o_orderpriority", 3, 100))
        completion = _case(k % 9, ["100%", "1", "0.5", "50", "1%", "nan", "", "Postponed", "Approved"])
        return self.table("orders").select(
            k.alias("unique_id"), release.alias("release"), wg.alias("resource_names"), completion.alias("completion")
        )

    @property
    def pages(self) -> DataFrame:
        return self.table("pages")

    # -- listings, report files, work-plan files, fetch log, model texts ----
    @property
    def listing(self) -> DataFrame:
        """Meeting-folder listing per working group: real folders plus a junk folder every tenth report."""
        d = self.table("documents").select(_doc().alias("doc_id"))
        wg = _case(_doc() % 3, ["RAN1", "SA2", "RAN2"])
        code = _case(_doc() % 3, ["R1", "S2", "R2"])
        href = F.when(_doc() % 10 == 0, F.lit("Templates/")).otherwise(
            F.concat(F.lit("TSG"), code, F.lit("_"), _doc().cast("string"), F.lit("/"))
        )
        return d.select("doc_id", wg.alias("working_group"), href.alias("href"))

    @property
    def report_files(self) -> DataFrame:
        """Files of each meeting folder, in listing order (pos)."""
        d = self.table("documents").select(_doc().alias("doc_id"))
        names = F.array(
            F.concat(F.lit("Agenda_"), _doc().cast("string"), F.lit(".txt")),
            F.when(_doc() % 4 == 0, F.concat(F.lit("Final_Report_"), _doc().cast("string"), F.lit(".htm")))
            .when(_doc() % 4 == 1, F.concat(F.lit("Draft_"), _doc().cast("string"), F.lit(".doc")))
            .when(_doc() % 4 == 2, F.concat(F.lit("summary_"), _doc().cast("string"), F.lit(".pdf")))
            .otherwise(F.concat(F.lit("notes_"), _doc().cast("string"), F.lit(".txt"))),
            F.concat(F.lit("Report_"), _doc().cast("string"), F.lit(".html")),
        )
        return d.select("doc_id", F.posexplode(names).alias("pos", "href"))

    @property
    def work_plan_files(self) -> DataFrame:
        """Work-plan folder listing: workbook files in two spellings, plus other files."""
        d = self.table("documents").select(_doc().alias("doc_id"))
        href = (
            F.when(_doc() % 3 == 0, F.concat(F.lit("Work_plan_3gpp_"), (_doc() + 240000).cast("string"), F.lit(".xlsx")))
            .when(_doc() % 3 == 1, F.concat(F.lit("archive/work_plan_3gpp_"), _doc().cast("string"), F.lit(".XLSX")))
            .otherwise(F.concat(F.lit("readme_"), _doc().cast("string"), F.lit(".txt")))
        )
        return d.select("doc_id", href.alias("href"))

    @property
    def fetch_log(self) -> DataFrame:
        """Fetch log over the pages: status, error text and content type vary with the page id."""
        p = self.table("pages")
        pid = F.col("page_id")
        return p.select(
            "page_id",
            "url",
            (pid % 5 != 1).alias("success"),
            F.col("html").alias("content"),
            F.when(pid % 5 == 1, 403).when(pid % 5 == 2, 429).otherwise(200).alias("status_code"),
            F.when(pid % 5 == 1, F.lit("Forbidden")).when(pid % 5 == 3, F.lit("Bot check failed")).alias("error"),
            F.when(pid % 7 == 0, F.lit("application/rss+xml")).otherwise(F.lit("text/html")).alias("content_type"),
        )

    @property
    def model_texts(self) -> DataFrame:
        """Raw scorer answers per entry: plain, fenced, wrapped in prose, or not JSON."""
        d = self.table("documents").select(_doc().alias("doc_id"))
        flag = _case(_doc() % 5, ["true", '"yes"', '"false"', "0", "null"])
        region = _case(_doc() % 9, PROFILE_REGIONS)
        body = F.concat(
            F.lit('{"is_6g_relevant": '), flag,
            F.lit(', "overall_6g_importance": '), (_doc() % 10 + 1).cast("string"),
            F.lit(', "source_region": "'), region, F.lit('", "6g_topics": ["t'), (_doc() % 3).cast("string"), F.lit('"]}'),
        )
        raw = (
            F.when(_doc() % 4 == 0, body)
            .when(_doc() % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .when(_doc() % 4 == 2, F.concat(F.lit("Sure. "), body, F.lit(" Hope this helps.")))
            .otherwise(F.lit("I cannot answer that."))
        )
        return d.select("doc_id", raw.alias("raw_text"))
