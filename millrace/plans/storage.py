"""Queries that go through files, schemas, sets and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import schemas
from millrace.functions import registry, scalars, selectors, text
from millrace.operators import chunking, integrity, mutations, report, search, store
from millrace.plans import sql
from millrace.plans.catalog import query
from millrace.sources import files


@query("postings_files", "SELECT id::VARCHAR AS id, title, lower(company) AS company, location, status FROM jobs")
def _(v):
    """Postings written a folder for each company and read again."""
    path = files.scratch(v.spark, "postings")
    files.write_postings(v.jobs.withColumn("id", F.col("id").cast("string")), path)
    return v.spark.read.json(path).select("id", "title", "company", "location", "status")


@query("crawled_files", "SELECT id::VARCHAR AS id, title, company, status FROM jobs")
def _(v):
    """Postings of files by pattern; rows that aren't postings, and files named preprocessed, are left out."""
    path = files.scratch(v.spark, "crawled")
    rows = v.jobs.select(F.col("id").cast("string").alias("id"), "title", "company", "location", "status")
    bad = rows.withColumn("title", F.lit(None).cast("string"))

    def put(df, name: str) -> None:
        # a file holds one array, of an eighth of a company's postings
        lists = df.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(8))).groupBy("company", "part").agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))
        lists.repartition("company", "part").write.partitionBy("company", "part").text(f"{path}/{name}")

    put(rows.unionByName(bad), "a")
    put(rows, "preprocessed")
    good, _bad = files.postings(v.spark, f"{path}/a", "*.txt")
    return good.select("id", "title", "company", "status")


@query("companies_config", "SELECT 'c' || n_nationkey AS company, n_nationkey % 3 <> 0 AS enabled, CASE WHEN n_nationkey % 2 = 0 THEN 'new ' ELSE '' END || n_name AS name, 'h' || n_regionkey AS title_selector FROM nation", views=False)
def _(v):
    """Companies of a folder of files: of one in two files the later file's."""
    path = files.scratch(v.spark, "companies")
    own = v.table("nation")

    def put(rows, name: str, before: str) -> None:
        one = F.struct((F.col("n_nationkey") % 3 != 0).alias("enabled"), F.concat(F.lit(before), "n_name").alias("name"), F.lit("u").alias("url"), F.create_map(F.lit("title"), F.concat(F.lit("h"), F.col("n_regionkey").cast("string"))).alias("selectors"))
        held = rows.agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")), one))).alias("companies"))  # a configuration's few rows
        # a folder's files are read by name
        held.coalesce(1).write.json(f"{path}/{name}")

    put(own, "1", "")
    put(own.filter("n_nationkey % 2 = 0"), "2", "new ")
    read = v.spark.read.schema(files.COMPANIES).json([f"{path}/1", f"{path}/2"]).select(F.explode("companies").alias("company", "c"), F.col("_metadata.file_path").alias("file")).select("company", "c.*", F.regexp_extract("file", r"/([12])/[^/]*$", 1).alias("file"))
    last = store.latest_per_key(read, ["company"], [F.desc("file")])
    return last.select("company", "enabled", "name", F.col("selectors.title").alias("title_selector"))


@query("enabled_companies", "SELECT count(*) FILTER (WHERE c_custkey % 3 <> 0) AS enabled, count(*) FILTER (WHERE c_custkey % 3 = 0) AS disabled FROM customer", views=False)
def _(v):
    on, off = store.enabled(v.table("customer").withColumn("enabled", F.when(F.col("c_custkey") % 3 == 0, False).when(F.col("c_custkey") % 3 == 1, True)))
    return on.agg(F.count("*").alias("enabled")).crossJoin(off.agg(F.count("*").alias("disabled")))


@query("csv_export", "SELECT id::VARCHAR AS id, title, (SELECT count(*) FROM jobs) AS written FROM jobs")
def _(v):
    path = files.scratch(v.spark, "csv")
    n = files.write_csv(v.jobs.select("id", "title"), path)
    return v.spark.read.option("header", True).csv(path).withColumn("written", F.lit(n))


@query("issue_files", "SELECT 'duplicate_assessment' AS issue_type, job_id::VARCHAR AS record_id FROM assessments UNION ALL SELECT 'invalid_score', job_id::VARCHAR FROM assessments WHERE overall_score + 60 > 100")
def _(v):
    """Issues written a folder for each type and read again."""
    some = v.assessments
    found = integrity.duplicates(store.repeated(some, F.lit(2))).unionByName(integrity.invalid_scores(some.select("job_id", (F.col("overall_score") + 60).alias("overall_score"), *[F.lit(1.0).alias(n) for n in integrity.SCORES[1:]])))
    path = files.scratch(v.spark, "issues")
    files.write_issues(found, path)
    return v.spark.read.option("header", True).csv(path).select("issue_type", F.col("record_id").cast("string").alias("record_id"))


@query("metric_export", "SELECT 'n' AS metric, count(*)::VARCHAR AS value FROM assessments UNION ALL SELECT 'high', (count(*) FILTER (WHERE overall_score >= 75))::VARCHAR FROM assessments UNION ALL SELECT 'low', (count(*) FILTER (WHERE overall_score < 50))::VARCHAR FROM assessments")
def _(v):
    path = files.scratch(v.spark, "metrics")
    files.write_json(files.metric_rows(report.analytics(v.assessments).select("n", "high", "low")), path)
    return v.spark.read.json(path).select("metric", "value")


@query("whole_text_files", "SELECT n_nationkey, md5(n_name || chr(10) || n_regionkey) AS digest FROM nation", views=False)
def _(v):
    """Texts written one to a file and read whole."""
    path = files.scratch(v.spark, "texts")
    v.table("nation").select("n_nationkey", F.concat("n_name", F.lit("\n"), F.col("n_regionkey").cast("string")).alias("line")).write.partitionBy("n_nationkey").text(path)
    read = files.profile(v.spark, f"{path}/*/*.txt").withColumn("n", F.regexp_extract(F.input_file_name(), r"n_nationkey=(\d+)", 1))
    return read.select(F.col("n").cast("long").alias("n_nationkey"), F.md5(F.btrim("profile", F.lit("\n"))).alias("digest"))


@query("selected_elements", r"""SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1), '<[^>]*>', '', 'g'), ' ' || chr(10) || chr(9)), '') AS ad, regexp_extract(html, '<nav><ul><li><a href="([^"]*)"', 1) AS first_link, len(regexp_extract_all(html, '<li>')) AS items FROM pages""", views=False)
def _(v):
    h = F.col("html")
    return v.spread("pages").select("page_id", selectors.selected(h, "div.ad").alias("ad"), selectors.selected(h, "nav > ul a", "href").alias("first_link"), F.size(selectors.contents(h, "nav li")).cast("long").alias("items"))


@query("landed_pages", r"""SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS company, page_id AS title, 'Not specified' AS location, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/job/' || page_id AS url, CASE WHEN page_id % 2 = 0 THEN 'more ' || page_id END AS description FROM pages WHERE page_id % 5 <> 0""", views=False)
def _(v):
    """Pages as crawled lists: those without a title go, links are made absolute, details are joined."""
    n = F.col("page_id").cast("string")
    pages = v.table("pages").select(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("company"), "url", F.concat_ws("|", F.when(F.col("page_id") % 5 != 0, n).otherwise(""), F.concat(F.lit("/job/"), n)).alias("html"))
    parts = F.split
    got = files.landed(pages, lambda x: F.struct(parts(x, r"\|")[0].alias("title"), F.lit("").alias("location"), parts(x, r"\|")[1].alias("link"))).drop("html")
    details = got.filter(F.col("title").cast("long") % 2 == 0).select("url", F.concat(F.lit("more "), "title").alias("description"))
    return files.with_details(got, details.unionByName(details)).withColumn("title", F.col("title").cast("long"))


@query("schema_migration", "SELECT job_id, status, NULL::VARCHAR AS reason, 0::BIGINT AS tokens, coalesce(CASE WHEN job_id % 2 = 0 THEN preprocessing_version END, 'v1.0') AS preprocessing_version FROM reviews")
def _(v):
    """Rows of an older table: a renamed column, absent ones added, null versions filled."""
    old = v.reviews.select(F.col("job_id").alias("id"), "status", F.when(F.col("job_id") % 2 == 0, F.col("preprocessing_version")).alias("preprocessing_version"), F.lit(1).alias("gone"))
    new = mutations.backfilled_versions(schemas.align_to(schemas.renamed(old, "id", "job_id"), schemas.REVIEWS, {"tokens": 0}))
    return new.select(F.col("job_id").cast("long").alias("job_id"), "status", "reason", "tokens", "preprocessing_version")


@query("bound_statement", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000", views=False)
def _(v):
    v.table("orders").createOrReplaceTempView("bound_orders")
    return registry.execute(v.spark, "SELECT o_orderkey, o_orderpriority FROM bound_orders WHERE o_orderpriority = :what AND o_totalprice > :least", what="1-URGENT", least=200000)


@query("index_integrity", "SELECT 'fts_orphan' AS issue_type, 'info' AS severity, count(*) || ' rows without an assessment' AS details FROM assessments WHERE job_id % 4 = 0 UNION ALL SELECT 'fts_data_mismatch', 'error', count(*) || ' rows without an id' FROM assessments WHERE job_id % 6 = 0")
def _(v):
    rows = v.assessments.withColumn("row_id", F.col("job_id"))
    index = integrity.rebuilt_index(rows).withColumn("job_id", F.when(F.col("row_id") % 6 != 0, F.col("job_id")))
    base = rows.filter("job_id % 4 <> 0")
    return integrity.index_orphans(index, base).unionByName(integrity.index_mismatch(index)).select("issue_type", "severity", "details")


@query("malformed_search", "SELECT job_id FROM assessments WHERE contains(lower(title), '\"urgent') OR contains(lower(title), '-urg')")
def _(v):
    """A query that can't be read falls back to a plain part of any column."""
    odd = search.search_or_like(v.assessments, '"urgent', ("title",)).select("job_id")
    return odd.unionByName(search.search_or_like(v.assessments, "(-urg", ("title",)).select("job_id")).unionByName(v.assessments.filter(F.lower("title").contains("-urg")).select("job_id"))


@query("confirmed_of_all", "SELECT count(*) FILTER (WHERE status = 'confirmed') AS confirmed, count(*) AS n FROM reviews")
def _(v):
    return store.filtered(v.reviews, "confirmed").agg(F.count("*").alias("confirmed")).crossJoin(v.reviews.agg(F.count("*").alias("n")))


_HEADED = "CASE doc_id % 6 WHEN 0 THEN concat('# ', lang) WHEN 1 THEN concat('### ', source) WHEN 2 THEN concat('**', source, ':**') WHEN 3 THEN concat('- **', lang, '**') WHEN 4 THEN concat('**', lang, '** and') ELSE text END"


@query("header_levels", f"SELECT doc_id, level, CASE WHEN level > 0 THEN trim(regexp_replace(t, '^#+\\s+', ''), ' ') WHEN level = -1 THEN regexp_extract(t, '^\\*\\*(.*?)\\*\\*$', 1) END AS title FROM (SELECT doc_id, t, CASE WHEN regexp_matches(t, '^#{{1,3}}\\s+\\S') THEN length(regexp_extract(t, '^(#+)', 1)) WHEN regexp_matches(t, '^\\*\\*[^*]+\\*\\*:?$') THEN -1 ELSE -2 END AS level FROM (SELECT doc_id, split_part({_HEADED}, chr(10), 1) AS t FROM documents))", views=False)
def _(v):
    line = F.substring_index(F.expr(_HEADED), "\n", 1)
    return v.table("documents").select("doc_id", line.alias("t")).select("doc_id", text.header_level(F.col("t")).cast("long").alias("level"), text.header_title(F.col("t")).alias("title"))


@query("named_stages", "SELECT doc_id, md5(regexp_replace(" + "regexp_replace(" * 3 + "'**x** ' || text" + "".join(f", '{p}', '\\1', 'g')" for p in (r"\*\*(.+?)\*\*", "__(.+?)__", r"\*(.+?)\*")) + ", '_(.+?)_', '\\1', 'g')) AS digest FROM documents", views=False)
def _(v):
    made = v.spread("documents").select("doc_id", F.concat(F.lit("**x** "), "text").alias("x"))
    return registry.applied(made, "x", ["emphasis"]).select("doc_id", F.md5("x").alias("digest"))


@query("moments", "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS day_s, epoch(o_orderdate)::BIGINT + 3723 AS iso_s, epoch(o_orderdate)::BIGINT - 3600 AS offset_s, o_orderdate <= TIMESTAMP '1998-01-01' - INTERVAL 400 DAY AS old FROM orders", views=False)
def _(v):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    at = F.col("o_orderdate").cast("timestamp")
    return v.table("orders").select(
        "o_orderkey",
        F.unix_seconds(scalars.utc_date(day)).alias("day_s"),
        F.unix_seconds(scalars.iso_moment(F.concat(day, F.lit("T01:02:03Z")))).alias("iso_s"),
        F.unix_seconds(scalars.iso_moment(F.concat(day, F.lit("T00:00:00+01:00")))).alias("offset_s"),
        scalars.older_than(at, 400, F.lit("1998-01-01").cast("timestamp")).alias("old"),
    )


@query("set_operations", "SELECT p_partkey, array_to_string(list_sort(list_intersect(a, b)), ' ') AS both, array_to_string(list_sort(list_distinct(list_concat(a, b))), ' ') AS either, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ' ') AS rest FROM (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part)", views=False)
def _(v):
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    joined = lambda c: F.array_join(F.array_sort(c), " ")
    a, b = words("p_name"), words("p_type")
    return v.table("part").select("p_partkey", joined(F.array_intersect(a, b)).alias("both"), joined(F.array_union(a, b)).alias("either"), joined(F.array_except(a, b)).alias("rest"))


@query("metric_union", "SELECT 'jobs' AS name, count(*)::DOUBLE AS value FROM jobs UNION ALL SELECT 'reviews', count(*)::DOUBLE FROM reviews UNION ALL SELECT 'cost', round(sum(actual_cost), 4) FROM assessments")
def _(v):
    one = lambda df, name, value: df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("name"), "value")
    return one(v.jobs, "jobs", F.count("*")).unionByName(one(v.reviews, "reviews", F.count("*"))).unionByName(one(v.assessments, "cost", F.round(F.sum("actual_cost"), 4)))


@query("issue_report", "SELECT '# Integrity' || chr(10) || chr(10) || '- error: duplicate_assessment (' || count(*) || ')' || chr(10) || '- warning: missing_preprocessing (' || count(*) FILTER (WHERE job_id % 5 = 0) || ')' AS report FROM assessments")
def _(v):
    some = v.assessments
    found = integrity.duplicates(store.repeated(some, F.lit(2))).unionByName(integrity.missing_preprocessing(v.assessments, v.assessments.filter("job_id % 5 <> 0")))
    return report.issue_report(found)


@query("posting_texts", "SELECT o_orderkey, concat_ws(chr(10), nullif(o_orderpriority, ''), CASE WHEN o_orderkey % 2 = 0 THEN 'Ulm' END, 'a & b' || chr(10) || 'of ' || o_orderstatus) AS body FROM orders", views=False)
def _(v):
    body = F.concat(F.lit("<p data-x='1'>a &amp; b</p><div>of "), "o_orderstatus", F.lit("</div>"))
    return v.table("orders").select("o_orderkey", text.posting_text(F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 0, "Ulm"), body).alias("body"))


_BUDGET = 40
_HELD = "list_transform(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda z: trim(z, ' ')), lambda z: z <> ''), lambda s: {'s': s, 'n': len(" + sql.words("s") + ")::BIGINT})"
_FOLD = f"CASE WHEN a.s <> '' AND greatest(1, floor((a.n + x.n) * 1.3)) > {_BUDGET} THEN {{'s': a.s || chr(3) || x.s, 'n': x.n}} ELSE {{'s': CASE WHEN a.s = '' THEN x.s ELSE a.s || '. ' || x.s END, 'n': a.n + x.n}} END"


@query("budgeted_chunks", f"SELECT doc_id, (generate_subscripts(c, 1) - 1)::INT AS n, unnest(c) AS chunk FROM (SELECT doc_id, list_filter(string_split(list_reduce({_HELD}, lambda a, x: {_FOLD}, {{'s': '', 'n': 0::BIGINT}}).s, chr(3)), lambda z: z <> '') AS c FROM documents)", views=False)
def _(v):
    return v.spread("documents").select("doc_id", F.posexplode(chunking.budgeted(F.col("text"), _BUDGET)).alias("n", "chunk"))


@query("chunk_tokens", "SELECT doc_id, coalesce(list_sum(list_transform(" + sql.chunks(sql.sentences("text"), 100) + ", lambda c: greatest(1, floor(len(" + sql.words("c") + ") * 1.3::DOUBLE))::BIGINT)), 0)::BIGINT AS tokens FROM documents", views=False)
def _(v):
    return v.spread("documents").select("doc_id", chunking.text_chunks(F.col("text")).alias("c")).select("doc_id", chunking.total_tokens(F.col("c")).alias("tokens"))
