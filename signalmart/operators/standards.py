"""Standards-body operators: meeting reports, listings, work-plan rows.

Inputs are tables (reports, listing pages, sheet rows, tool-result texts), so
every step is a projection or an aggregate over rows; no document is decoded
on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import scalars, text, urls
from . import aggs, filters
from .joins import join_aggregate


# ---------------------------------------------------------------------------
# meeting reports
# ---------------------------------------------------------------------------


def parse_meeting_reports(reports: DataFrame, content: str = "content", content_type: str | None = None, data_source: str = "live") -> DataFrame:
    """All five extractors -> one M12 row per report, with at most 10 agreements and 20 references as M12 has them.

    The report text is computed once in an inner projection and reused by the
    extractors (Catalyst keeps it as one common sub-expression).
    """
    kind = F.col(content_type) if content_type else F.lit("text")
    t = reports.withColumn("_text", text.text_of(F.col(content), kind))
    return t.select(
        F.col("meeting_id").cast("string").alias("meeting_id"),
        "working_group",
        text.extract_date(F.col("_text")).alias("date"),
        text.extract_location(F.col("_text")).alias("location"),
        text.extract_agreements(F.col("_text"), 10).alias("key_agreements"),
        text.extract_tdocs(F.col("_text"), 20).alias("tdoc_references"),
        text.sentiment(F.col("_text")).alias("sentiment"),
        F.lit(data_source).alias("data_source"),
    )


def listing_to_meetings(dirs: DataFrame, run_date: str, name: str = "meeting_dir", group: str = "working_group") -> DataFrame:
    """Listing folders -> skeleton meeting rows (date = run date, location TBD, neutral, live)."""
    return dirs.select(
        urls.dir_name_trim(F.col(name)).alias("meeting_id"),
        F.col(group).alias("working_group"),
        F.lit(run_date).alias("date"),
        F.lit("TBD").alias("location"),
        F.array().cast("array<string>").alias("key_agreements"),
        F.array().cast("array<string>").alias("tdoc_references"),
        F.lit("neutral").alias("sentiment"),
        F.lit("live").alias("data_source"),
    )


def recent_meetings(meetings: DataFrame, working_group: str | None = None) -> DataFrame:
    """Meetings, optionally of one group (argument upper-cased)."""
    if working_group:
        return meetings.where(F.col("working_group") == working_group.upper())
    return meetings


# ---------------------------------------------------------------------------
# work items
# ---------------------------------------------------------------------------

SOURCE_COLUMNS = {"unique_id": "name", "name": "title", "release": "release", "resource_names": "working_group"}


def map_work_items(rows: DataFrame, mapping: dict[str, str] | None = None, completion: str = "completion") -> DataFrame:
    """Remote-reader rows -> M11: rename, to string, strip; status from the completion cell."""
    mapping = mapping or SOURCE_COLUMNS
    have = {c.lower(): c for c in rows.columns}
    cols = []
    for src, dst in mapping.items():
        if src in have:
            cols.append(scalars.py_strip(F.coalesce(F.col(have[src]).cast("string"), F.lit(""))).alias(dst))
        else:
            cols.append(F.lit("").alias(dst))
    comp = F.col(have[completion]) if completion in have else F.lit(None).cast("string")
    return rows.select(*cols, scalars.work_item_status_a(comp).alias("status"))


def work_item_totals(items: DataFrame) -> DataFrame:
    """Tool path: totals and per-group counts, group names as they are."""
    return aggs.work_item_rollup(items, "status", "working_group")


def workbook_items(rows: DataFrame) -> DataFrame:
    """Workbook path: release filter by marker, three-way status, group upper-cased."""
    it = filters.filter_release_fuzzy(rows, "release")
    return it.select(
        "name",
        "release",
        F.upper(F.coalesce(F.col("working_group"), F.lit("Other"))).alias("working_group"),
        scalars.work_item_status_b(F.col("status")).alias("status"),
    )


def release_status(totals: DataFrame, as_of: str, data_source: str = "live") -> DataFrame:
    """One row of the release-status query (defaults 0 / '' / 'unknown' when nothing was read)."""
    t = totals.where(F.col("level") == "total")
    g = totals.where(F.col("level") == "group")
    one = t.select(
        F.col("progress").alias("progress_percentage"),
        "completed",
        F.col("total").alias("total_work_items"),
        "in_progress",
        "postponed",
    ).unionByName(
        # one entry per working group: a map of a few dozen groups
        g.agg(
            F.count(F.lit(1)).alias("working_groups"),
            F.map_from_entries(
                F.array_sort(F.collect_list(F.struct(F.coalesce("working_group", F.lit("")).alias("key"), F.struct("total", "completed", "in_progress", "postponed", "progress").alias("value"))))
            ).alias("work_items_by_group"),
        ),
        allowMissingColumns=True,
    )
    return one.agg(
        F.coalesce(F.max("progress_percentage"), F.lit(0.0)).alias("progress_percentage"),
        F.coalesce(F.max("completed"), F.lit(0)).cast("long").alias("completed"),
        F.coalesce(F.max("total_work_items"), F.lit(0)).cast("long").alias("total_work_items"),
        F.coalesce(F.max("in_progress"), F.lit(0)).cast("long").alias("in_progress"),
        F.coalesce(F.max("postponed"), F.lit(0)).cast("long").alias("postponed"),
        F.lit(as_of).alias("last_updated"),
        F.lit(data_source).alias("data_source"),
        F.coalesce(F.max("working_groups"), F.lit(0)).cast("long").alias("working_groups"),
        F.any_value("work_items_by_group", ignoreNulls=True).alias("work_items_by_group"),
    )


# ---------------------------------------------------------------------------
# workbook sheets as row tables
# ---------------------------------------------------------------------------


def work_plan_sheet_pick(sheets: DataFrame, names=dims.WORK_ITEM_SHEET_NAMES) -> DataFrame:
    """(sheet_ord, sheet_name) -> the first sheet whose name has a known label, else the first sheet."""
    low = F.lower(F.col("sheet_name"))
    match = F.lit(False)
    for n in names:
        match = match | low.contains(n.lower())
    return sheets.agg(F.min_by(F.struct("sheet_ord", "sheet_name"), F.struct((~match).alias("m"), F.col("sheet_ord"))).alias("s")).select("s.*")


def _cell_has(cell: Column, words) -> Column:
    low = F.lower(cell)
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def _col_index(headers: Column, words) -> Column:
    """0-based index of the first header containing one of ``words``; null when none."""
    pos = F.array_position(F.transform(headers, lambda h: _cell_has(h, words)), F.lit(True))
    return F.when(pos > 0, pos - 1)


def work_plan_rows(rows: DataFrame, max_header_row: int = 10) -> DataFrame:
    """Sheet rows (row_idx, cells) -> work items (name, status, release, working_group).

    Header = the first of the first ``max_header_row`` rows with a cell holding a
    marker; columns resolve to the first header with a keyword from each list
    (note "wi" also matches e.g. "width", as in the tracked parser).  Rows after
    the header with a non-empty name are kept; missing cells -> "".
    Works per sheet (``sheet_ord`` when present): the header row is a one-row
    aggregate per sheet joined back (one row per sheet on the build side).
    """
    if "sheet_ord" not in rows.columns:
        rows = rows.withColumn("sheet_ord", F.lit(0))
    key = ["sheet_ord"]
    cand = rows.where(
        (F.col("row_idx") <= max_header_row)
        & F.exists("cells", lambda c: c.isNotNull() & _cell_has(c, dims.HEADER_MARKERS))
    )
    hdr = cand.groupBy(*key).agg(F.min_by("cells", "row_idx").alias("_h"), F.min("row_idx").alias("_hrow"))
    heads = F.transform("_h", lambda c: F.coalesce(py_str(c), F.lit("")))
    hdr = hdr.select(
        *key,
        "_hrow",
        *[_col_index(heads, kws).alias(f"_i_{k}") for k, kws in dims.COLUMN_KEYWORDS.items()],
    )
    j = rows.join(hdr, key, "inner")
    body = j.where((F.col("row_idx") > F.col("_hrow")) & F.exists("cells", lambda c: F.coalesce(c, F.lit("")) != ""))

    def cell(k):
        idx = F.col(f"_i_{k}")
        v = F.when(idx.isNotNull() & (idx < F.size("cells")), F.get(F.col("cells"), idx))
        return F.when(F.coalesce(v, F.lit("")) != "", scalars.py_strip(v)).otherwise(F.lit(""))

    out = body.select(*key, "row_idx", *[cell(k).alias(k) for k in ("name", "status", "release", "working_group")])
    return out.where(F.col("name") != "")


def py_str(c: Column) -> Column:
    return scalars.py_strip(c.cast("string"))


# ---------------------------------------------------------------------------
# tool results
# ---------------------------------------------------------------------------


def json_list_or_items(results: DataFrame, keep_plain: bool = False) -> DataFrame:
    """Tool-result texts (call_id, ord, text) -> items (call_id, ord, pos, item).

    One text that is a JSON list -> its elements; one non-list JSON value ->
    itself; several texts -> each parsed.  Text that is not JSON is skipped, or
    kept as a plain string item when ``keep_plain`` (listing results).  Object
    items come back as JSON text, string items as the string.
    """
    n = results.groupBy("call_id").agg(F.count(F.lit(1)).alias("_n"))
    r = join_aggregate(results, n, "call_id").withColumn("_v", F.try_parse_json("text"))
    kind = F.schema_of_variant(F.col("_v"))
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    value = F.when(nested, F.to_json(F.col("_v"))).otherwise(F.try_variant_get(F.col("_v"), "$", "string"))
    items = F.when((F.col("_n") == 1) & kind.startswith("ARRAY"), F.from_json(F.col("text"), "array<string>")).when(
        F.col("_v").isNotNull(), F.array(value)
    )
    if keep_plain:
        items = items.otherwise(F.array(F.col("text")))
    out = r.select("call_id", "ord", F.posexplode(items).alias("pos", "item"))
    return out


def standards_bundle(totals: DataFrame, meetings: DataFrame, as_of: str, data_source: str = "live", per_group: int | None = None) -> DataFrame:
    """One standardization record: release progress (totals + per-group map) and the recent meetings.

    ``totals`` comes from ``work_item_rollup`` (one total row + one row per
    group); every meeting given is listed, or the newest ``per_group`` of each
    working group.  The record holds its meetings as one list and is made by one
    task, so callers with very many meetings take ``standards_bundle_rows``
    instead.  The parts are combined by a union and one global aggregate (no
    join).
    """
    from .topk import top_k_per_group

    if per_group is not None:
        meetings = top_k_per_group(meetings, ["working_group"], [F.desc("date"), F.desc("meeting_id")], per_group).drop("rank")
    grp = totals.where(F.col("level") == "group").select(
        F.struct(
            F.coalesce(F.col("working_group"), F.lit("")).alias("key"),
            F.struct("total", "completed", "in_progress", "postponed", "progress").alias("value"),
        ).alias("g")
    )
    tot = totals.where(F.col("level") == "total").select(
        F.struct(
            F.col("total").alias("total_work_items"), "completed", "in_progress", "postponed",
            F.col("progress").alias("progress_percentage"),
        ).alias("t")
    )
    mt = meetings.select(F.struct(*[F.col(c) for c in meetings.columns]).alias("m"))
    u = grp.unionByName(tot, allowMissingColumns=True).unionByName(mt, allowMissingColumns=True)
    agg = u.agg(
        F.max("t").alias("t"),
        F.map_from_entries(F.collect_list("g")).alias("by_group"),
        F.array_sort(F.collect_list("m")).alias("recent_meetings"),
    )
    progress = F.struct(
        F.coalesce(F.col("t.total_work_items"), F.lit(0)).cast("long").alias("total_work_items"),
        F.coalesce(F.col("t.completed"), F.lit(0)).cast("long").alias("completed"),
        F.coalesce(F.col("t.in_progress"), F.lit(0)).cast("long").alias("in_progress"),
        F.coalesce(F.col("t.postponed"), F.lit(0)).cast("long").alias("postponed"),
        F.coalesce(F.col("t.progress_percentage"), F.lit(0.0)).alias("progress_percentage"),
        F.lit(as_of).alias("last_updated"),
        F.lit(data_source).alias("data_source"),
        F.col("by_group").alias("work_items_by_group"),
    )
    return agg.select(progress.alias("release_21_progress"), "recent_meetings")


def standards_bundle_rows(totals: DataFrame | None, meetings: DataFrame | None, as_of: str, data_source: str = "live") -> DataFrame:
    """The standardization record as rows (level, key, counts, last_updated, data_source, meeting); no row grows with the input.

    One 'progress' row (zeros where ``totals`` has no total row), one 'group'
    row per working group and one 'meeting' row per meeting given, the whole
    meeting as a struct.  A part that is None has no rows.
    """
    counts = ("total", "completed", "in_progress", "postponed")
    parts = []
    if totals is not None:
        top = F.col("level") == "total"
        parts.append(
            totals.agg(
                *[F.coalesce(F.max(F.when(top, F.col(c))), F.lit(0)).cast("long").alias(c) for c in counts],
                F.coalesce(F.max(F.when(top, F.col("progress"))), F.lit(0.0)).alias("progress"),
            ).select(F.lit("progress").alias("level"), F.lit(None).cast("string").alias("key"), *counts, "progress", F.lit(as_of).alias("last_updated"), F.lit(data_source).alias("data_source"))
        )
        parts.append(totals.where(F.col("level") == "group").select("level", F.coalesce(F.col("working_group"), F.lit("")).alias("key"), *counts, "progress"))
    if meetings is not None:
        parts.append(meetings.select(F.lit("meeting").alias("level"), F.col("meeting_id").alias("key"), F.struct(*[F.col(c) for c in meetings.columns]).alias("meeting")))
    if not parts:
        raise ValueError("neither totals nor meetings given")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
