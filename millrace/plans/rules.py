"""Queries of rules over words, sections and sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.operators import requirements
from millrace.plans import sql
from millrace.plans.catalog import query
from millrace.plans.texts import SAID, said

_PHRASE = "CASE l_linenumber WHEN 1 THEN 'Web Framework' WHEN 2 THEN p_name || ' database' WHEN 3 THEN 'software ' || p_name WHEN 4 THEN 'system' ELSE p_name END"


def _any(column, parts):
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


@query(
    "compound_scores",
    f"SELECT l_orderkey AS id, l_partkey AS part, CASE WHEN length(t) < 3 THEN 0.0 WHEN t IN ({', '.join(chr(39) + c + chr(39) for c in rules.COMPOUNDS)}) THEN 0.95 WHEN contains(t, ' ') AND {_any('t', rules.COMPOUND_WORDS)} THEN 0.7 WHEN contains(t, ' ') AND {_any('t', rules.COMPOUND_STARTS)} THEN 0.55 ELSE 0.0 END::DOUBLE AS score FROM (SELECT *, lower(trim({_PHRASE})) AS t FROM lineitem JOIN part ON l_partkey = p_partkey)",
    views=False,
)
def _(v):
    lines = v.table("lineitem").join(v.table("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part"), rules.compound_score(F.expr(_PHRASE)).alias("score"))


@query("noise_words", f"SELECT lang, count(*) FILTER (WHERE w IN ({', '.join(chr(39) + w + chr(39) for ws in rules.NOISE.values() for w in ws)})) AS noise, count(*) AS words FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')) AS w FROM documents) GROUP BY lang", views=False)
def _(v):
    words = v.table("documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x20\x09-\x0D]+"), 0)).alias("w"))
    return words.groupBy("lang").agg(F.count_if(rules.is_noise_word(F.col("w"))).alias("noise"), F.count("*").alias("words"))


_NAMES = ["'Boeing '", "'the Boeing Company'", "c_mktsegment"]


@query("employers", "SELECT c_custkey, t IN (" + ", ".join(f"'{n}'" for ns in rules.EMPLOYERS.values() for n in ns) + ") AS whole, " + _any("t", [n for ns in rules.EMPLOYERS.values() for n in ns]) + " AS part FROM (SELECT c_custkey, lower(trim(CASE c_custkey % 3 WHEN 0 THEN 'Boeing ' WHEN 1 THEN 'the Boeing Company' ELSE c_mktsegment END)) AS t FROM customer)", views=False)
def _(v):
    name = F.when(F.col("c_custkey") % 3 == 0, "Boeing ").when(F.col("c_custkey") % 3 == 1, "the Boeing Company").otherwise(F.col("c_mktsegment"))
    return v.table("customer").select("c_custkey", rules.is_employer(name).alias("whole"), rules.is_employer(name, whole=False).alias("part"))


#: Technologies whose patterns look ahead, which RE2 can't.
_AHEAD = sorted(n for n, ps in rules.TECHNOLOGIES.items() if any("(?!" in p for p in ps))
_NAMED = ", ".join("CASE WHEN " + " OR ".join(f"regexp_matches(t, {sql.quoted('(?i)' + p)})" for p in ps) + f" THEN {sql.quoted(n)} END" for n, ps in sorted(rules.TECHNOLOGIES.items()) if n not in _AHEAD)
_USED = "concat(sentence, CASE kind WHEN 0 THEN ' DOORS NG, JIRA, K8s, ReactJS' WHEN 1 THEN ' AI coding techniques on ARM with Simulink' WHEN 2 THEN ' C++, RESTful APIs, Postgres' ELSE '' END)"


@query("named_technologies", SAID + f"SELECT id, part, kind, array_to_string(list_filter([{_NAMED}], lambda x: x IS NOT NULL), '|') AS technologies FROM (SELECT id, part, kind, {_USED} AS t FROM said)", views=False)
def _(v):
    named = rules.named_technologies(F.expr(_USED))
    return said(v).select("id", "part", "kind", F.array_join(F.filter(named, lambda x: ~x.isin(*_AHEAD)), "|").alias("technologies"))


@query("employer_of_markdown", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Acme ' || o_orderpriority WHEN 1 THEN 'Field Co ' || o_orderkey ELSE 'Blue Robotics' END AS employer FROM orders", views=False)
def _(v):
    n = F.col("o_orderkey")
    md = F.when(n % 3 == 0, F.concat(F.lit("intro\n# Acme "), "o_orderpriority", F.lit("\ntext"))).when(n % 3 == 1, F.concat(F.lit("x\nCompany:  Field Co "), n.cast("string"), F.lit("\ny"))).otherwise("Blue Robotics is a company")
    return v.table("orders").select("o_orderkey", rules.employer(md).alias("employer"))


@query("requirements_part", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ' know ' || o_orderpriority || ' ' ELSE '' END AS part FROM orders", views=False)
def _(v):
    body = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("About us. Requirements: know "), "o_orderpriority", F.lit(" Benefits: tea. Compliance."))).otherwise(F.col("o_orderpriority"))
    return v.table("orders").select("o_orderkey", rules.requirements_part(body).alias("part"))


@query("without_remarks", "SELECT o_orderkey, 'keep ' || o_orderpriority || chr(10) || 'end' AS kept FROM orders", views=False)
def _(v):
    body = F.concat(F.lit("keep "), "o_orderpriority", F.lit("\nSalary: 5\nRemote work\nend"))
    return v.table("orders").select("o_orderkey", rules.without_remarks(body).alias("kept"))


@query("markdown_flags", "SELECT doc_id, regexp_matches(text, '(?m)^#+\\s+|^[*\\-+]\\s+|^\\d+\\.\\s+|\\*\\*.*?\\*\\*|__.*?__|`.*?`') AS md FROM documents", views=False)
def _(v):
    return v.table("documents").select("doc_id", rules.is_markdown(F.col("text")).alias("md"))


@query("section_map", "SELECT o_orderkey, 'new ' || o_orderpriority AS qualifications, 'c' AS responsibilities, 3 AS n FROM orders", views=False)
def _(v):
    md = F.concat(F.lit("lost\n## Requirements\nold\n## What you do:\nc\nBase pay is fine\n**Odd Head**\nx\n## Minimum qualifications\nnew "), "o_orderpriority")
    found = v.spread("orders").select("o_orderkey", rules.section_map(md).alias("m"))
    return found.select("o_orderkey", F.col("m.qualifications").alias("qualifications"), F.col("m.responsibilities").alias("responsibilities"), F.size("m").alias("n"))


@query("narrative_requirements", SAID + "SELECT id, part, kind, CASE WHEN kind IN (1, 4, 6) THEN 1 ELSE 0 END AS n FROM said", views=False)
def _(v):
    return said(v).select("id", "part", "kind", F.size(rules.narrative(F.col("sentence"))).alias("n"))


@query("experience_fields", SAID + "SELECT id, part, kind, CASE WHEN kind = 4 THEN regexp_extract(sentence, 'with ([^,]+),', 1) ELSE '' END AS fields FROM said", views=False)
def _(v):
    return said(v).select("id", "part", "kind", F.array_join(rules.fields(F.col("sentence"), "experience"), "|").alias("fields"))


@query("plainer_requirements", SAID + "SELECT id, part, 'Experience in x and y with ' || part AS plain FROM said", views=False)
def _(v):
    made = F.concat(F.lit("Demonstrated experience with  x as well as y (e.g. z) with the development of "), F.col("part").cast("string"), F.lit(" (now)"))
    return said(v).select("id", "part", rules.plainer(made).alias("plain"))


@query("kept_words", SAID + "SELECT id, part, list_filter(regexp_extract_all(lower(sentence), '[\\p{L}\\p{N}][\\p{L}\\p{N}''+#.-]*'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in sorted({w for ws in rules.NOISE.values() for w in ws} - {"not", "no", "with", "without", "and", "or"})) + ")).array_to_string(' ') AS words FROM said", views=False)
def _(v):
    return said(v).select("id", "part", F.array_join(rules.kept_words(F.col("sentence")), " ").alias("words"))


@query("bullet_texts", "SELECT o_orderkey, 'first item|second ' || o_orderpriority AS items FROM orders", views=False)
def _(v):
    md = F.concat(F.lit("* first item\n- tiny\n• second "), "o_orderpriority", F.lit("\nplain"))
    return v.table("orders").select("o_orderkey", F.array_join(rules.bullet_texts(md), "|").alias("items"))


@query("sentence_requirements", SAID + f'SELECT id, part, sentence, "trigger", confidence, priority, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, part, sentence) AS rank FROM ({sql.classified("SELECT * FROM said")}) WHERE confidence >= 0.5) WHERE rank <= 20', views=False)
def _(v):
    """Sentences of documents' items with the best trigger each, at most 20 to a posting."""
    from pyspark.sql import Window

    found = requirements.with_class(said(v), "sentence", "c").select("id", "part", "sentence", "c.*").filter("confidence >= 0.5")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("confidence"), "part", "sentence"))
    return found.withColumn("rank", rank).filter("rank <= 20")
