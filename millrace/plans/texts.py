"""Queries over texts and pages: cleaning, sections, chunks, search, requirements, entities, similarity, streams and files."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import boilerplate, lexicons, markdown, scalars, text
from millrace.operators import chunking, cost, report, requirements, scoring, search, similarity
from millrace.plans import batch, sql
from millrace.plans.catalog import query
from millrace.sources import files
from millrace.sources.partitions import dealt, parts_of
from millrace.streaming import events

#: Sentences of many kinds, one for each line item by its number.
TEMPLATES = [
    "Required: {q}+ years of {p} experience.",
    "Must have knowledge of {p} and Python.",
    "A {p} certificate is not required for this role.",
    "Nice to have {p} skills.",
    "Experience with {p}, Docker and SQL is preferred if {q} people ask.",
    "We sell {p} to many people.",
    "Strong communication skills and the ability to lead {q} people.",
]


def said(v):
    """(id, sentence): a sentence for each posting's line item."""
    lines = v.spread("lineitem").join(v.table("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    kind = F.pmod(F.col("l_orderkey") + F.col("l_partkey"), F.lit(len(TEMPLATES)))
    out = F.lit(TEMPLATES[0])
    for i, t in enumerate(TEMPLATES):
        out = F.when(kind == i, t).otherwise(out)
    quantity = F.col("l_quantity").cast("int").cast("string")
    return lines.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part"), kind.alias("kind"), F.replace(F.replace(out, F.lit("{q}"), quantity), F.lit("{p}"), F.col("p_name")).alias("sentence"))


def sentence_lists(v):
    """(id, s): each posting's own sentences."""
    return dealt(said(v), "id", v.table("lineitem")).groupBy("id").agg(F.array_sort(F.collect_list("sentence")).alias("s"))


SAID = (
    "WITH said AS (SELECT l_orderkey AS id, l_partkey AS part, (l_orderkey + l_partkey) % "
    + str(len(TEMPLATES))
    + " AS kind, replace(replace(CASE (l_orderkey + l_partkey) % "
    + str(len(TEMPLATES))
    + "".join(f" WHEN {i} THEN '{t}'" for i, t in enumerate(TEMPLATES))
    + " END, '{q}', l_quantity::INT::VARCHAR), '{p}', p_name) AS sentence FROM lineitem JOIN part ON l_partkey = p_partkey) "
)


@query("trigger_requirements", SAID + 'SELECT id, part, kind, "trigger", confidence FROM (' + sql.classified("SELECT * FROM said") + ")", views=False)
def _(v):
    return requirements.with_class(said(v), "sentence", "c").select("id", "part", "kind", "c.trigger", "c.confidence")


@query("requirement_spans")
def _(v):
    spans = F.explode(requirements.requirement_spans(F.col("sentence"))).alias("s")
    return said(v).select("id", "part", spans).select("id", "part", "s.*")


@query("technologies", SAID + f"SELECT id, part, kind, array_to_string({sql.found_words('sentence', lexicons.terms(lexicons.TECHNOLOGY))}, ',') AS technologies FROM said", views=False)
def _(v):
    return said(v).select("id", "part", "kind", F.array_join(lexicons.found_words(F.col("sentence"), lexicons.terms(lexicons.TECHNOLOGY)), ",").alias("technologies"))


@query("soft_skills", SAID + f"SELECT id, part, kind, array_to_string({sql.found_phrases('sentence', lexicons.terms(lexicons.SOFT_SKILLS))}, ',') AS skills FROM said", views=False)
def _(v):
    return said(v).select("id", "part", "kind", F.array_join(lexicons.found_phrases(F.col("sentence"), lexicons.terms(lexicons.SOFT_SKILLS)), ",").alias("skills"))


_DOMAIN_SQL = ", ".join("(" + " + ".join(f"regexp_matches(t, '(?i){p}')::INT" for p in ps) + f") AS {n}" for n, ps in lexicons.DOMAINS.items())
_DOMAIN_TEXT = "CASE user_id % 5 WHEN 0 THEN 'Flight operations and telemetry system for an aircraft dynamics team' WHEN 1 THEN 'Cloud infrastructure, REST API and CI/CD microservices' WHEN 2 THEN 'Secret Clearance for a DoD weapons system' WHEN 3 THEN 'Verilog, FPGA synthesis and DFT' ELSE event_type END"


@query("domain_detection", f"SELECT event_id, CASE WHEN greatest(aerospace, software, defense, hardware) = 0 THEN 'general' WHEN aerospace = greatest(aerospace, software, defense, hardware) THEN 'aerospace' WHEN software = greatest(software, defense, hardware) THEN 'software' WHEN defense >= hardware THEN 'defense' ELSE 'hardware' END AS domain FROM (SELECT event_id, {_DOMAIN_SQL} FROM (SELECT event_id, lower({_DOMAIN_TEXT}) AS t FROM events))", views=False)
def _(v):
    return v.table("events").select("event_id", lexicons.domain(F.expr(_DOMAIN_TEXT)).alias("domain"))


_LEXICONS = {"technology": lexicons.TECHNOLOGY, "soft_skills": lexicons.SOFT_SKILLS}


@query("lexicon_counts", "SELECT lexicon, category, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS lexicon, '{c}' AS category, unnest({sql.listed(ts)}) AS term" for n, x in _LEXICONS.items() for c, ts in x.items()) + ") GROUP BY ALL", views=False)
def _(v):
    return lexicons.counts(lexicons.table(v.spark, technology=lexicons.TECHNOLOGY, soft_skills=lexicons.SOFT_SKILLS))


_FLIPS = r"(len(list_filter(string_split(regexp_replace(regexp_replace(e, '([a-z])([A-Z])', '\1' || chr(1) || '\2', 'g'), '([A-Z])([a-z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda z: z <> '')) - 1)"
_FRAGMENT = rf"({_FLIPS} >= 3 AND lower(e) <> 'javascript') OR length(regexp_replace(e, '[^(\[{{]', '', 'g')) <> length(regexp_replace(e, '[^)\]}}]', '', 'g')) OR regexp_matches(e, '<[^>]*>|&\w+;') OR (len(regexp_split_to_array(trim(e), '\s+')) >= 4 AND regexp_matches(e, '(?i)\s(?:and|or|but)\s'))"
_NOISE = r"length(trim(e)) NOT BETWEEN 2 AND 70 OR regexp_matches(trim(e), '^[\d\s.,%+-]+$') OR contains(e, '$') OR regexp_matches(trim(e), '(?i)^(?:the|a|an)\s')"


@query("entity_filter", f"SELECT p_partkey, array_to_string(list_sort(list(DISTINCT e)), '|') AS entities FROM (SELECT p_partkey, unnest([p_name, 'the ' || p_name, '(open', '12%', 'JavaScript', p_brand, 'one two and three four']) AS e FROM part) WHERE NOT ({_FRAGMENT}) AND NOT ({_NOISE}) GROUP BY p_partkey", views=False)
def _(v):
    made = F.array(F.col("p_name"), F.concat(F.lit("the "), "p_name"), F.lit("(open"), F.lit("12%"), F.lit("JavaScript"), F.col("p_brand"), F.lit("one two and three four"))
    return v.table("part").select("p_partkey", F.array_join(lexicons.entities(made, ("javascript",)), "|").alias("entities"))


_FACTS = {"years": r"\d+\+?\s*(?:years|yrs)", "degrees": r"(?:Bachelor|Master|PhD|BS|MS|BA|MA)(?:''s)?(?:\s+degree)?", "citizen": r"(?:U\.?S\.?\s+)?[Cc]itizen(?:ship)?"}
_STATED = " A Master's degree, MS or BS; U.S. citizen, citizenship."


@query("facts", SAID + "SELECT id, part, " + ", ".join(f"array_to_string(list_sort(list_distinct(regexp_extract_all(sentence || {sql.quoted(_STATED)}, '{p}'))), '|') AS {n}" for n, p in _FACTS.items()) + " FROM said", views=False)
def _(v):
    rows = said(v).select("id", "part", lexicons.facts(F.concat("sentence", F.lit(_STATED))).alias("f")).select("id", "part", "f.*")
    return rows.withColumns({n: F.array_join(F.array_sort(n), "|") for n in _FACTS})


_IN_SECTIONS = "SELECT id, 1 AS line, part, sentence, 0.15 AS boost, 'REQUIREMENTS' AS label FROM said UNION ALL SELECT DISTINCT id, 2, 0, 'Ability to sing.', -0.25, 'NICE_TO_HAVE' FROM said"
_BY_SECTION = sql.classified("SELECT * EXCLUDE (sentence), unnest(" + sql.sentences("sentence") + f") AS sentence FROM ({_IN_SECTIONS})")


@query(
    "sections",
    SAID
    + f"""SELECT id AS doc_id, requirement, "trigger", confidence AS base_confidence, boost::DOUBLE AS section_boost, label AS section, final_confidence, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY final_confidence DESC, line, requirement) AS rank FROM (
    SELECT DISTINCT id, line, sentence AS requirement, "trigger", confidence, boost, label, round(greatest(0, least(1, confidence + boost)), 3)::DOUBLE AS final_confidence FROM ({_BY_SECTION})) WHERE final_confidence >= 0.5) WHERE rank <= 20""",
    views=False,
)
def _(v):
    docs = sentence_lists(v).select(F.col("id").alias("doc_id"), F.concat(F.lit("# Role\n\n## Requirements\n- "), F.array_join("s", "\n- "), F.lit("\n\n## Benefits\nRequired: a smile.\n\n**Nice to have**\nAbility to sing.")).alias("text"))
    return requirements.by_section(docs)


@query("fuzzy_dedup")
def _(v):
    return sentence_lists(v).select("id", similarity.fuzzy_distinct(F.col("s")).alias("kept"))


@query("exact_dedup", "SELECT source, low AS phrase, n_chars FROM (SELECT source, lower(trim(p)) AS low, n_chars, row_number() OVER (PARTITION BY source, lower(trim(p)) ORDER BY n_chars DESC, doc_id) AS r FROM (SELECT source, doc_id, n_chars, regexp_extract(text, '^\\S+') AS p FROM documents)) WHERE r = 1", views=False)
def _(v):
    docs = v.spread("documents").select("source", "doc_id", "n_chars", F.regexp_extract("text", r"^\S+", 0).alias("p"))
    best = docs.withColumn("p", F.lower("p"))
    return similarity.exact_distinct(best, "p", "n_chars", ["source"], ["doc_id"]).select("source", F.trim("p").alias("phrase"), "n_chars")


@query("content_duplicates", "SELECT sha256(text) AS hash, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1", views=False)
def _(v):
    return similarity.content_duplicates(v.spread("documents"), "doc_id", "text")


@query("word_tokens", "SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE greatest(1, floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) * 1.3::DOUBLE)) END::BIGINT AS tokens FROM documents", views=False)
def _(v):
    return v.spread("documents").select("doc_id", scalars.word_tokens(F.col("text")).alias("tokens"))


@query("token_costs", "SELECT doc_id, round(n / 1e6 * 3.0 + 300 / 1e6 * 15.0, 9) AS cost FROM (SELECT doc_id, greatest(1, floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) * 1.3::DOUBLE)) AS n FROM documents)", views=False)
def _(v):
    return v.spread("documents").select("doc_id", F.round(cost.call_cost(scalars.word_tokens(F.col("text")), F.lit(300), 3.0, 15.0), 9).alias("cost"))


@query("sentences", "SELECT doc_id, (generate_subscripts(s, 1) - 1)::INT AS n, unnest(s) AS sentence FROM (SELECT doc_id, " + sql.sentences("text") + " AS s FROM documents)", views=False)
def _(v):
    return v.spread("documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("n", "sentence"))


@query("chunks", "SELECT *, len(" + sql.words("chunk") + ")::INT AS words FROM (SELECT doc_id, (generate_subscripts(c, 1) - 1)::INT AS n, unnest(c) AS chunk FROM (SELECT doc_id, " + sql.chunks("s", 100) + " AS c FROM (SELECT doc_id, " + sql.sentences("text") + " AS s FROM documents)))", views=False)
def _(v):
    docs = v.spread("documents").select("doc_id", text.sentences(F.col("text")).alias("s")).select("doc_id", chunking.chunked(F.col("s")).alias("c"))
    return docs.select("doc_id", F.posexplode("c").alias("n", "chunk")).withColumn("words", F.size(scalars.words(F.col("chunk"))))


@query("line_stats", "SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n_filled FROM documents", views=False)
def _(v):
    parts = text.lines(F.col("text"))
    return v.spread("documents").select("doc_id", F.size(parts).cast("long").alias("n_lines"), F.size(F.filter(parts, lambda x: F.trim(x) != "")).cast("long").alias("n_filled"))


@query("boilerplate_flags", "SELECT doc_id, " + " OR ".join(f"regexp_matches(text, '{p}')" for p in boilerplate.CATALOG["navigation"]) + " AS navigation, " + " OR ".join(f"regexp_matches(text, '{p}')" for p in boilerplate.CATALOG["company_boilerplate"]) + " AS company FROM documents", views=False)
def _(v):
    return v.spread("documents").select("doc_id", boilerplate.has_boilerplate(F.col("text"), "navigation").alias("navigation"), boilerplate.has_boilerplate(F.col("text"), "company_boilerplate").alias("company"))


def _removed(column: str) -> str:
    out = column
    for category in ("legal_compliance", "company_boilerplate", "navigation"):
        for p in boilerplate.CATALOG[category]:
            out = f"regexp_replace({out}, '{p}', '', 'g')"
    return out


@query("boilerplate_removed", f"SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, {_removed('text')} AS t FROM documents)", views=False)
def _(v):
    clean = boilerplate.without_boilerplate(F.col("text"), ("section_headers", "time_references", "salary_benefits", "special_formatting"))
    return v.spread("documents").select("doc_id", F.length(clean).cast("long").alias("n"), F.md5(clean).alias("digest"))


@query("clean_html", f"SELECT page_id, {sql.cleaned('html')} AS clean FROM pages", views=False)
def _(v):
    return v.spread("pages").select("page_id", text.clean_description(F.col("html")).alias("clean"))


@query("plain_html", r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'),
    '(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr|ul|ol|article|section|header|footer|nav|title)\s*>', chr(10), 'g'), '<[^>]*>', '', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\x0B\f\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS plain FROM pages""", views=False)
def _(v):
    return v.spread("pages").select("page_id", text.plain(F.col("html")).alias("plain"))


@query("html_markdown", f"SELECT page_id, {sql.markdown('html')} AS md FROM pages", views=False)
def _(v):
    return v.spread("pages").select("page_id", markdown.html_to_markdown(F.col("html")).alias("md"))


@query("structured_markdown", f"SELECT page_id, {sql.structured('md')} AS md FROM (SELECT page_id, {sql.markdown('html')} AS md FROM pages)", views=False)
def _(v):
    return v.spread("pages").select("page_id", text.structured(markdown.html_to_markdown(F.col("html"))).alias("md"))


_MARKED = "CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN '' WHEN 2 THEN concat(text, ' AT&amp;T') WHEN 3 THEN concat(text, '<BR>') WHEN 4 THEN concat(text, ' <A HREF=x>') ELSE concat('a &LT; b ', text) END"


@query("raw_html_flags", f"SELECT doc_id, t = '' OR len(list_filter({sql.listed(text.RAW_HTML)}, lambda m: contains(lower(t), m))) > 0 AS raw FROM (SELECT doc_id, {_MARKED} AS t FROM documents)", views=False)
def _(v):
    return v.table("documents").select("doc_id", text.is_raw_html(F.expr(_MARKED)).alias("raw"))


@query("markdown_sections", f"SELECT page_id, (generate_subscripts(s, 1) - 1)::INT AS n, unnest(s) AS section FROM (SELECT page_id, {sql.sections('md')} AS s FROM (SELECT page_id, {sql.markdown('html')} AS md FROM pages))", views=False)
def _(v):
    md = markdown.html_to_markdown(F.col("html"))
    return v.spread("pages").select("page_id", F.posexplode(text.sections(md)).alias("n", "section"))


#: Texts with some lines made list items and continuations of them.
_LISTS = r"regexp_replace(regexp_replace(replace(text, '. ', chr(10)), '(?m)^([A-M])', '- \1', 'g'), '(?m)^([a-h])', '   \1', 'g')"
_ITEM = r"'^\s*(?:[*+•-]|\d+[.)])\s+'"
_ITEMS = rf"""list_reduce(list_transform(string_split(md, chr(10)), lambda l: {{'s': l, 'open': false}}), lambda a, x:
  CASE WHEN regexp_matches(x.s, {_ITEM}) THEN {{'s': a.s || chr(1) || trim(regexp_replace(x.s, {_ITEM}, ''), ' '), 'open': true}}
    WHEN a.open AND regexp_matches(x.s, '^\s+\S') THEN {{'s': a.s || ' ' || trim(x.s, ' '), 'open': true}} WHEN trim(x.s, ' ') = '' THEN a ELSE {{'s': a.s, 'open': false}} END, {{'s': '', 'open': false}}).s"""


@query("bullets", f"SELECT doc_id, unnest(i) AS bullet, generate_subscripts(i, 1) - 1 AS n FROM (SELECT doc_id, string_split({_ITEMS}, chr(1))[2:] AS i FROM (SELECT doc_id, {_LISTS} AS md FROM documents))", views=False)
def _(v):
    md = F.regexp_replace(F.regexp_replace(F.replace("text", F.lit(". "), F.lit("\n")), r"(?m)^([A-M])", "- $1"), r"(?m)^([a-h])", "   $1")
    return v.spread("documents").select("doc_id", F.posexplode(text.bullets(md)).alias("n", "bullet")).withColumn("n", F.col("n").cast("long"))


@query("bullets_plain", "SELECT o_orderkey, 'one.' || chr(10) || 'two: x.' || chr(10) || o_orderpriority AS md FROM orders", views=False)
def _(v):
    return v.table("orders").select("o_orderkey", text.bullets_plain(F.concat(F.lit("- one\n* two: x.\n"), "o_orderpriority")).alias("md"))


_MD = ("**Bold** and __strong__ ‘q’ – “x”… ", "\n\n\n*end* _of it_")
_NORMAL = f"{sql.quoted(_MD[0])} || text || {sql.quoted(_MD[1])}"
for _p in (r"\*\*(.+?)\*\*", "__(.+?)__", r"\*(.+?)\*", "_(.+?)_"):
    _NORMAL = f"regexp_replace({_NORMAL}, '{_p}', '\\1', 'g')"
_NORMAL = f"regexp_replace(replace(translate({_NORMAL}, '‘’“”–—', {sql.quoted(chr(39) * 2 + chr(34) * 2 + '--')}), '…', '...'), '\\n{{3,}}', chr(10) || chr(10), 'g')"


@query("normalized_markdown", f"SELECT doc_id, md5({_NORMAL}) AS md FROM documents", views=False)
def _(v):
    return v.spread("documents").select("doc_id", F.md5(text.normalized(F.concat(F.lit(_MD[0]), "text", F.lit(_MD[1])))).alias("md"))


@query("polished_markdown", f"SELECT page_id, {sql.polished('md')} AS md FROM (SELECT page_id, {sql.markdown('html')} AS md FROM pages)", views=False)
def _(v):
    return v.spread("pages").select("page_id", text.polished(markdown.html_to_markdown(F.col("html"))).alias("md"))


@query("display_formats", "SELECT p_partkey, CASE WHEN length(p_name || p_type) > 14 THEN (p_name || p_type)[1:11] || '...' ELSE p_name || p_type END AS cut, printf('$%.6f', p_retailprice) AS price, CASE WHEN p_size < 60 THEN p_size || 's' END AS took FROM part", views=False)
def _(v):
    return v.table("part").select("p_partkey", scalars.truncated(F.concat("p_name", "p_type"), 14).alias("cut"), scalars.usd(F.col("p_retailprice")).alias("price"), scalars.duration(F.col("p_size")).alias("took"))


@query("scoring_replies", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS overall_score, CASE WHEN event_id % 3 <> 0 THEN 10.0 ELSE 50.0 END::DOUBLE AS tech_score FROM events".replace("CASE WHEN event_id % 3 <> 0 THEN value END", "CASE WHEN event_id % 3 <> 0 THEN value ELSE 50.0 END"), views=False)
def _(v):
    body = F.concat(F.lit('```json\n{"overall_score": '), F.col("value").cast("string"), F.lit(', "tech_score": 10.0, "seniority_score": 20.0'), F.when(F.col("event_id") % 3 != 0, ', "location_score": 5').otherwise(""), F.lit("}\n```"))
    got = scalars.scoring_defaults(scalars.scoring_reply(body))
    return v.table("events").select("event_id", got["overall_score"].alias("overall_score"), got["tech_score"].alias("tech_score"))


FTS = r"""SELECT doc_id, regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿœæß', 'aaaaaaceeeeiiiinoooooouuuuyyoas'), '[\p{L}\p{N}]+') AS w FROM documents"""


@query("fts_and", f"SELECT doc_id FROM ({FTS}) WHERE list_contains(w, 'the') AND list_contains(w, 'that')", views=False)
def _(v):
    return search.search(v.spread("documents"), "the That", ("text",)).select("doc_id")


@query("fts_boolean", f"SELECT doc_id FROM ({FTS}) WHERE (list_contains(w, 'der') OR list_contains(w, 'les')) AND NOT list_contains(w, 'und')", views=False)
def _(v):
    return search.search(v.spread("documents"), "(der OR les) NOT und", ("text",)).select("doc_id")


@query("fts_phrase", f"SELECT doc_id FROM ({FTS}) WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')", views=False)
def _(v):
    return search.search(v.spread("documents"), '"of the"', ("text",)).select("doc_id")


@query("fts_prefix", f"SELECT doc_id FROM ({FTS}) WHERE len(list_filter(w, lambda x: starts_with(x, 'tionth'))) > 0", views=False)
def _(v):
    return search.search(v.spread("documents"), "tionth*", ("text",)).select("doc_id")


@query("fts_indexed", f"SELECT doc_id FROM ({FTS}) WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ') AND NOT list_contains(w, 'was')", views=False)
def _(v):
    docs = v.spread("documents").select("doc_id", "text")
    return search.indexed(docs, search.index(docs, "doc_id", ["text"]), '"of the" NOT was', "doc_id").select("doc_id")


@query("keyword_search", "SELECT job_id, overall_score FROM assessments WHERE regexp_matches(lower(title || ' ' || company || ' ' || summary || ' ' || recommendations), '\\burgent\\b') AND regexp_matches(lower(title || ' ' || company || ' ' || summary || ' ' || recommendations), '\\bmachinery\\b') AND overall_score BETWEEN 40 AND 90 ORDER BY overall_score DESC, job_id LIMIT 20")
def _(v):
    return search.keyword(v.assessments, "urgent machinery", 40, 90).select("job_id", "overall_score")


_LOOKED = "regexp_extract_all(lower(concat_ws(' ', title, company, summary)), '[a-z0-9]+')"


@query("keyword_lookup", f"SELECT job_id, overall_score FROM assessments WHERE list_contains({_LOOKED}, 'urgent') AND list_contains({_LOOKED}, 'machinery') AND overall_score BETWEEN 40 AND 90 ORDER BY overall_score DESC, job_id LIMIT 20")
def _(v):
    """A search through an index that is stored first."""
    path = files.scratch(v.spark, "index")
    search.write_index(v.assessments, "job_id", ["title", "company", "summary"], path, parts_of(v.table("lineitem")))
    return search.lookup(v.assessments, path, "urgent machinery", "job_id", 40, 90).select("job_id", "overall_score")


@query("frequent_words", "SELECT lang, word, n FROM (SELECT lang, word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS r FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')) AS word FROM documents) GROUP BY lang, word) WHERE r <= 10", views=False)
def _(v):
    from pyspark.sql import Window

    words = v.spread("documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x20\x09-\x0D]+"), 0)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    return words.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter("r <= 10").drop("r")


@query("windowed_events", "SELECT epoch(date_trunc('day', ts))::BIGINT AS day_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", views=False)
def _(v):
    return events.windowed(events.stamped(v.table("events"))).select(F.unix_seconds("window_start").alias("day_s"), "event_type", "n", "total")


@query(
    "sessionized_timeline",
    """SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""",
    views=False,
)
def _(v):
    return events.sessions(events.stamped(v.table("events"))).select("user_id", F.unix_micros("session_start").alias("start_us"), "n")


@query("event_props", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events", views=False)
def _(v):
    return v.table("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


_CARD = """concat_ws(chr(10), '### ' || title || ' at ' || company, '- Score: ' || printf('%.1f', overall_score), '- Location: ' || location,
  CASE WHEN starts_with(recommendations, '["l') THEN '- Advice: ' || array_to_string(from_json(recommendations, '["VARCHAR"]'), '; ') END, summary)"""


@query(
    "report_markdown",
    f"""SELECT '# Assessments' || chr(10) || chr(10) || '## Top 10' || chr(10) || chr(10) || (SELECT string_agg(card, chr(10) || chr(10) ORDER BY overall_score DESC, job_id) FROM (SELECT job_id, overall_score, {_CARD} AS card FROM assessments ORDER BY overall_score DESC, job_id LIMIT 10))
  || chr(10) || chr(10) || '## Figures' || chr(10) || chr(10) || (SELECT printf('%d assessments, average %.1f, from %.1f to %.1f; %d high, %d medium, %d low', count(*), round(avg(overall_score), 1), min(overall_score), max(overall_score), count(*) FILTER (WHERE overall_score >= 75), count(*) FILTER (WHERE overall_score >= 50 AND overall_score < 75), count(*) FILTER (WHERE overall_score < 50)) FROM assessments) AS report""",
)
def _(v):
    return report.markdown(v.assessments)


@query("analytics", "SELECT count(*) AS n, round(avg(overall_score), 1) AS avg_score, min(overall_score) AS min_score, max(overall_score) AS max_score, count(*) FILTER (WHERE overall_score >= 75) AS high, count(*) FILTER (WHERE overall_score >= 50 AND overall_score < 75) AS medium, count(*) FILTER (WHERE overall_score < 50) AS low, round(sum(input_tokens) * 100.0 / sum(input_tokens + output_tokens), 1) AS input_percent FROM assessments")
def _(v):
    return report.analytics(v.assessments)


_OVERLAP = "CASE WHEN len({0}) = 0 THEN 100.0 ELSE len(list_intersect({0}, {1})) * 100.0 / len({0}) END::DOUBLE"


@query(
    "entity_score",
    f"""SELECT *, (skill_match + tech_match + requirements_match) / 3 AS overall_entity_score, tech_match * 0.4::DOUBLE + skill_match * 0.3::DOUBLE + 50.0 * 0.3::DOUBLE AS overall_score FROM (
  SELECT p_partkey, {_OVERLAP.format('s', "['cold', 'widget']")} AS skill_match, {_OVERLAP.format('t', "['economy']")} AS tech_match, 100.0::DOUBLE AS requirements_match
  FROM (SELECT p_partkey, list_distinct(string_split_regex(lower(p_name), '\\s+')) AS s, list_distinct(string_split_regex(lower(p_type), '\\s+')) AS t FROM part))""",
    views=False,
)
def _(v):
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\s+"))
    jobs = v.table("part").select("p_partkey", words("p_name").alias("skills"), words("p_type").alias("technologies"), F.array().cast("array<string>").alias("requirements"))
    profile = v.spark.createDataFrame([(["cold", "widget"], ["economy"], ["x"])], T.StructType.fromDDL("skills array<string>, technologies array<string>, requirements array<string>"))
    return scoring.offline(scoring.entity_scores(jobs, profile)).select("p_partkey", "skill_match", "tech_match", "requirements_match", "overall_entity_score", "overall_score")


def _postings(v):
    pages = v.spread("pages")
    return pages.select(F.col("page_id").alias("id"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("url", r"://([^/]+)", 1).alias("company"), F.lit("Remote").alias("location"), "url", F.col("html").alias("description"))


_POSTED = f"""SELECT page_id, title, company, {sql.sentences("concat_ws(chr(10), nullif(title, ''), 'Remote', nullif(clean, ''))")} AS s, concat_ws(chr(10), nullif(title, ''), 'Remote', nullif(clean, '')) AS body
  FROM (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(url, '://([^/]+)', 1) AS company, {sql.cleaned('html')} AS clean FROM pages)"""
_PREPARED = f"SELECT *, {sql.chunks('s', 100)} AS c FROM ({_POSTED})"
_COUNTED = f"SELECT *, coalesce(list_sum(list_transform(c, lambda x: greatest(1, floor(len({sql.words('x')}) * 1.3::DOUBLE)))), 0)::BIGINT AS token_count FROM ({_PREPARED})"


@query(
    "preprocessed_jobs",
    f"""SELECT page_id::VARCHAR AS job_id, title, company, len(s)::INT AS n_sentences, len(c)::INT AS n_chunks, token_count, round(token_count / 1e6 * 3.0 + 300 / 1e6 * 15.0, 9) AS estimated_cost,
  array_to_string({sql.found_words('body', lexicons.terms(lexicons.TECHNOLOGY))}, '|') AS technologies, array_to_string({sql.found_phrases('body', lexicons.terms(lexicons.SOFT_SKILLS))}, '|') AS skills FROM ({_COUNTED})""",
    views=False,
)
def _(v):
    done = batch.costs(batch.preprocessed(_postings(v)))
    return done.select("job_id", "title", "company", F.size("sentences").alias("n_sentences"), F.size("chunks").alias("n_chunks"), "token_count", F.round("estimated_cost", 9).alias("estimated_cost"), F.array_join("technologies", "|").alias("technologies"), F.array_join("skills", "|").alias("skills"))


@query("batch_report")
def _(v):
    profile = v.spark.createDataFrame([(["leadership"], ["python"], ["x"])], T.StructType.fromDDL("skills array<string>, technologies array<string>, requirements array<string>"))
    return batch.run(_postings(v), profile=profile)
