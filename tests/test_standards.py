"""Standards-body operators on hand-written rows: work items, sheets, listings, reports, fetch log."""

from pyspark.sql import functions as F

from signalmart.functions import scalars, text, urls
from signalmart.operators import aggs, filters, standards, topk
from signalmart.sources import pages

from .conftest import rows

COMPLETION = ["100%", "1", "0.5", "50", "1%", "nan", "", "Postponed", "approved", "-1", None, " 100 % ", "inf", "1e3", "delayed"]


def test_work_item_status_both_paths(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(COMPLETION)], "i int, c string")
    got = df.orderBy("i").select(scalars.work_item_status_a("c").alias("a"), scalars.work_item_status_b("c").alias("b")).collect()
    a = [r.a for r in got]
    b = [r.b for r in got]
    assert a == [
        "Completed", "Completed", "In Progress", "Completed", "In Progress", "In Progress", "In Progress",
        "In Progress", "Completed", "In Progress", "In Progress", "Completed", "Completed", "Completed", "In Progress",
    ]
    assert b == [
        "completed", "completed", "in_progress", "completed", "in_progress", "in_progress", "in_progress",
        "postponed", "completed", "postponed", "in_progress", "completed", "completed", "completed", "postponed",
    ]


def test_map_work_items_and_rollup(spark):
    src = spark.createDataFrame(
        [("WI-1 ", "Rel-21", " RAN1", "100%"), ("WI-2", "Rel-21", "RAN1", "0.5"), ("WI-3", "Rel-20", "SA2", "1"), ("WI-4", "Rel-21", "nan", "50")],
        "Unique_ID string, Release string, Resource_Names string, Completion string",
    )
    items = standards.map_work_items(src)
    assert rows(items, "name", "working_group", "status")[0] == ("WI-1", "RAN1", "Completed")
    tot = standards.work_item_totals(filters.filter_release_exact(items))
    t = {(r.level, r.working_group): (r.total, r.completed, r.in_progress, r.postponed, r.progress) for r in tot.collect()}
    assert t[("total", None)] == (3, 2, 1, 0, 66.7)
    assert t[("group", "RAN1")] == (2, 1, 1, 0, 50.0)
    assert t[("group", "nan")] == (1, 1, 0, 0, 100.0)
    status = standards.release_status(tot, "2024-06-30").first()
    assert (status.total_work_items, status.completed, status.working_groups, status.data_source) == (3, 2, 2, "live")
    empty = standards.release_status(tot.where(F.lit(False)), "2024-06-30").first()
    assert (empty.progress_percentage, empty.total_work_items, empty.working_groups) == (0.0, 0, 0)


def test_work_plan_sheet_and_rows(spark):
    sheets = spark.createDataFrame([(0, "Cover"), (1, "Summary"), (2, "WI Status 2026")], "sheet_ord int, sheet_name string")
    assert standards.work_plan_sheet_pick(sheets).first().sheet_ord == 2
    none = spark.createDataFrame([(0, "Cover"), (1, "Notes")], "sheet_ord int, sheet_name string")
    assert standards.work_plan_sheet_pick(none).first().sheet_ord == 0
    cells = [
        (1, ["3GPP work plan", None, None, None]),
        (2, [None, None, None, None]),
        (3, ["Unique_ID", "Title", "Release", "Completion"]),
        (4, ["FS_6G", "Study", "Rel-21", "50%"]),
        (5, [None, None, None, None]),
        (6, ["", "no name", "Rel-21", "1"]),
        (7, [" NR_x ", "Item", "Rel-20"]),
    ]
    df = spark.createDataFrame(cells, "row_idx int, cells array<string>")
    got = rows(standards.work_plan_rows(df), "name", "status", "release", "working_group")
    # "Title" contains no keyword; status resolves to "Completion"; "wi" is not in any header;
    # group: no wg header -> "" ; short row -> missing cell ""
    assert got == [("FS_6G", "50%", "Rel-21", ""), ("NR_x", "", "Rel-20", "")]


def test_listing_filters_top_k_and_skeletons(spark):
    html = (
        '<a href="TSGR1_99/">a</a><a href="TSGR1_115/">b</a><a href="TSGR1_116/">c</a><a href="Templates/">t</a>'
        '<a href="Work_plan_3gpp_260401.xlsx">w</a><a href="x/work_plan_3gpp_250101.XLSX">w2</a>'
        '<a href="Final_report.htm">r</a><a href="Draft.doc">d</a>'
    )
    links = pages.page_links(spark.createDataFrame([(1, html)], "page_id long, html string"))
    dirs = filters.filter_meeting_dirs(links).withColumn("working_group", F.lit("RAN1")).withColumnRenamed("href", "meeting_dir")
    top = topk.top_meetings_per_group(dirs, 2)
    assert sorted(r.meeting_dir for r in top.collect()) == ["TSGR1_116/", "TSGR1_99/"]
    sk = standards.listing_to_meetings(top, "2024-06-30").collect()
    assert {r.meeting_id for r in sk} == {"TSGR1_116", "TSGR1_99"} and sk[0].location == "TBD" and sk[0].sentiment == "neutral"
    wp = filters.filter_work_plan_files(links).select("href")
    assert sorted(r.href for r in wp.collect()) == ["Work_plan_3gpp_260401.xlsx", "x/work_plan_3gpp_250101.XLSX"]
    assert [r.href for r in filters.filter_work_plan_files(links, http_variant=True).collect()] == ["Work_plan_3gpp_260401.xlsx", "x/work_plan_3gpp_250101.XLSX"]
    files = wp.select(urls.file_name("href").alias("file_name"))
    assert topk.latest_by_name(files).first().file_name == "work_plan_3gpp_250101.XLSX"
    rep = topk.first_report_file(links, filters.is_report_file(F.col("href"))).first()
    assert rep.report_file == "Final_report.htm"
    kinds = spark.createDataFrame([("a.HTM",), ("b.pdf",)], "n string").select(filters.content_kind("n").alias("k"))
    assert [r.k for r in kinds.collect()] == ["html", "text"]


def test_meeting_report_parse(spark):
    html = (
        "<html><head><style>p{}</style><script>var a='agreed:';</script></head><body>"
        "<p>RAN1#115 held in Xiamen, China on 12/11/2023.</p><!-- decision: hidden -->"
        "<p>Agreed: adopt R1-2301234 &amp; R1-2301234. Way forward: study S6-1234567.</p>"
        "<p>Conclusion: FFS. Not agreed on S2-7654321!</p></body></html>"
    )
    df = spark.createDataFrame([("R1-115", "RAN1", html, "html")], "meeting_id string, working_group string, content string, content_type string")
    m = standards.parse_meeting_reports(df, content_type="content_type").first()
    assert m.date == "12/11/2023"
    assert m.location == "Xiamen, China"
    assert m.key_agreements == ["Agreed: adopt R1-2301234 & R1-2301234", "Way forward: study S6-1234567", "Conclusion: FFS"]
    assert m.tdoc_references == ["R1-2301234", "S2-7654321", "S6-1234567"]
    # comment dropped: pos 1 (agreed), neutral 1 (ffs), negative 1 (not agreed) -> mixed
    assert m.sentiment == "mixed"


def test_sentiment_classes(spark):
    df = spark.createDataFrame([(1, "approved and accepted"), (2, "postponed"), (3, "nothing"), (4, "FFS, agreed")], "i int, t string")
    got = [r.s for r in df.orderBy("i").select(text.sentiment("t").alias("s")).collect()]
    assert got == ["positive", "negative", "neutral", "mixed"]


def test_fetch_log_predicates_and_method_cache(spark):
    log = spark.createDataFrame(
        [
            ("https://a.org:8443/feed", True, "<?xml version='1.0'?><rss/>", 200, None, "httpx", 1),
            ("https://a.org:8443/feed", True, "<html><body>Attention Required! | Cloudflare</body></html>", 200, None, "httpx", 2),
            ("https://b.org/rss", False, None, 403, "Forbidden", "httpx", 3),
            ("https://b.org/rss", True, "<rss/>", 200, None, "playwright", 4),
            ("https://c.org/x", False, None, 500, "bot detected", "httpx", 5),
        ],
        "url string, success boolean, content string, status_code int, error string, method_used string, fetched_at int",
    )
    got = log.orderBy("fetched_at").select(
        filters.fetch_is_html("content").alias("h"),
        filters.fetch_needs_fallback("status_code", "error", "success", "content").alias("f"),
        filters.fetch_is_blocked("content").alias("b"),
    ).collect()
    assert [tuple(r) for r in got] == [(False, False, False), (True, True, True), (False, True, False), (False, False, False), (False, True, False)]
    best = dict((r.domain, r.method) for r in aggs.domain_best_method(log).collect())
    assert best == {"a.org:8443": "httpx", "b.org": "playwright"}


def test_url_helpers(spark):
    df = spark.createDataFrame(
        [
            (1, "https://user@x.org:8080/a/b.html?q=1", "../c", "javascript:alert(1)"),
            (2, "https://x.org", "feed.xml", "HTTP://ok.org/"),
            (3, "https://x.org/dir/", "/root.xml", "//cdn.org/x"),
            (4, "https://x.org/dir/page", "//cdn.org/f", "not a url"),
        ],
        "i int, base string, href string, u string",
    )
    got = df.orderBy("i").select(
        urls.url_domain("base").alias("d"), urls.resolve_url("base", "href").alias("r"), urls.safe_url("u").alias("s")
    ).collect()
    assert [r.d for r in got] == ["user@x.org:8080", "x.org", "x.org", "x.org"]
    assert [r.r for r in got] == ["https://user@x.org:8080/c", "https://x.org/feed.xml", "https://x.org/root.xml", "https://cdn.org/f"]
    assert [r.s for r in got] == ["#", "HTTP://ok.org/", "#", "#"]
    trimmed = spark.createDataFrame([("TSGR1_115/",), ("x",)], "n string").select(urls.dir_name_trim("n").alias("t"))
    assert [r.t for r in trimmed.collect()] == ["TSGR1_115", "x"]


def test_html_text_escape_and_wrapped_xml(spark):
    html = '<html><head><title>T &amp; U</title><style>p{}</style><script>x="</p>"</script></head><body><!-- c --><p> a &lt;b&gt; </p><br><p>&quot;q&quot; &middot; &copy;</p></body></html>'
    wrapped = "<html><body><pre>&lt;?xml version=\"1.0\"?&gt;&lt;rss&gt;&lt;/rss&gt;</pre></body></html>"
    df = spark.createDataFrame([(html, wrapped)], "h string, w string")
    r = df.select(text.html_to_text("h").alias("t"), text.escape_html(F.lit("<a href='x'>&</a>")).alias("e"), pages.extract_wrapped_xml("w").alias("x")).first()
    assert r.t == 'T & U a <b> "q" · ©'
    assert r.e == "&lt;a href=&#39;x&#39;&gt;&amp;&lt;/a&gt;"
    assert r.x == '<?xml version="1.0"?><rss></rss>'
    assert spark.createDataFrame([(None,)], "h string").select(text.escape_html("h")).first()[0] == ""


def test_json_list_or_items(spark):
    res = spark.createDataFrame(
        [
            (1, 0, '[{"Unique_ID": "A"}, {"Unique_ID": "B"}]'),
            (2, 0, '{"Unique_ID": "C"}'),
            (3, 0, '"TSGR1_115/"'),
            (3, 1, "TSGR1_116/"),
            (4, 0, "not json"),
        ],
        "call_id int, ord int, text string",
    )
    skip = rows(standards.json_list_or_items(res), "call_id", "item")
    assert skip == [(1, '{"Unique_ID":"A"}'), (1, '{"Unique_ID":"B"}'), (2, '{"Unique_ID":"C"}'), (3, "TSGR1_115/")]
    keep = rows(standards.json_list_or_items(res, keep_plain=True), "call_id", "item")
    assert (3, "TSGR1_116/") in keep and (4, "not json") in keep


def test_standards_bundle(spark):
    items = spark.createDataFrame([("a", "Completed", "RAN1"), ("b", "In Progress", "SA2")], "name string, status string, working_group string")
    tot = standards.work_item_totals(items)
    meet = spark.createDataFrame([("R1-1", "RAN1", "2024-01-01")], "meeting_id string, working_group string, date string")
    b = standards.standards_bundle(tot, meet, "2024-06-30").first()
    assert b.release_21_progress.total_work_items == 2 and b.release_21_progress.progress_percentage == 50.0
    assert b.release_21_progress.work_items_by_group["RAN1"].completed == 1
    assert b.recent_meetings[0].meeting_id == "R1-1"


def test_standards_bundle_rows(spark):
    items = spark.createDataFrame([("a", "Completed", "RAN1"), ("b", "In Progress", "SA2"), ("c", "Postponed", None)], "name string, status string, working_group string")
    meet = spark.createDataFrame([(f"R1-{i}", "RAN1", [f"t{i}"]) for i in range(50)], "meeting_id string, working_group string, tdoc_references array<string>")
    tot = standards.work_item_totals(items)
    got = standards.standards_bundle_rows(tot, meet, "2024-06-30")
    assert rows(got.where("level <> 'meeting'"), "level", "key", "total", "completed") == sorted(
        [("progress", None, 3, 1), ("group", "RAN1", 1, 1), ("group", "SA2", 1, 0), ("group", "", 1, 0)], key=repr
    )
    # a row for each meeting, whole
    found = got.where("level = 'meeting'").select("key", "meeting.tdoc_references").collect()
    assert sorted(map(tuple, found)) == sorted((f"R1-{i}", [f"t{i}"]) for i in range(50))
    empty = standards.standards_bundle_rows(standards.work_item_totals(items.limit(0)), meet.limit(0), "2024-06-30").collect()
    assert [(r.level, r.total, r.progress, r.last_updated) for r in empty] == [("progress", 0, 0.0, "2024-06-30")]


def test_extractors_without_limit_give_all(spark):
    report = ". ".join(f"agreed: number {i:02d}" for i in range(30)) + ". " + " ".join(f"R1-24{i:05d}" for i in range(45))
    df = spark.createDataFrame([(report,)], "t string")
    every = df.select(text.extract_agreements("t").alias("a"), text.extract_tdocs("t").alias("d")).first()
    assert [a[-2:] for a in every.a] == [f"{i:02d}" for i in range(30)] and len(every.d) == 45
    some = df.select(text.extract_agreements("t", 10).alias("a"), text.extract_tdocs("t", 20).alias("d")).first()
    assert some.a == every.a[:10] and some.d == every.d[:20]
    m = standards.parse_meeting_reports(spark.createDataFrame([("m", "RAN1", report)], "meeting_id string, working_group string, content string")).first()
    assert m.key_agreements == some.a and m.tdoc_references == some.d
