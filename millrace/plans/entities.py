"""Queries of skills, technologies and requirements found in postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import extraction, rules
from millrace.operators import requirements
from millrace.plans import sql
from millrace.plans.catalog import query

#: Parts of postings, put together by the order's number.
PARTS = [
    "Flight operations and Guidance and Control of a launch vehicle; Mentoring and coaching staff. Hardware in the loop tests.",
    "Cloud infrastructure and REST API design, CI/CD, distributed system maintenance, Code reviews and Technical documentation.",
    "Secret Clearance for a DoD weapons system with ARINC 429 buses. Systems maintenance, software architecture and integration testing.",
    "Verilog, FPGA synthesis and DFT. Timing analysis, Clock gating, Formal verification and performance work.",
    "We sell things. leadership, planning and review of management.",
]
QUALIFICATIONS = [
    "\n## Basic Qualifications\n- 5+ years of experience in avionics.\n- Knows {p} by heart\n- 3+ years of experience\n- short\n## Preferred Qualifications\n- Has flown {p} before\nBachelor's Degree; drug test.",
    "\n## Minimum Qualifications\n* Bachelor degree in engineering\n* Able to lift {p} alone\n\nPreferred: tea\n7 years experience with {p}\nU.S. citizen, background check",
    "\nRequired Qualifications:\n- Export control person of {p}\n- Top Secret holder of it\n---\nDesired experience\n- A coding challenge of {p}\nBackground: none",
]
_PICK = "element_at({0}, CAST(o_orderkey % {1} + 1 AS INT))"
_COMPANY = "CASE o_orderkey % 4 WHEN 0 THEN 'Boeing ' WHEN 1 THEN 'blue origin' WHEN 2 THEN 'acme' END"


def posts(v):
    """(o_orderkey, company, body, md): postings of parts with an order's priority in them."""
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("o_orderkey") % len(xs) + 1).cast("int"))
    asked = F.replace(pick(QUALIFICATIONS), F.lit("{p}"), F.col("o_orderpriority"))
    return v.spread("orders").select("o_orderkey", F.expr(_COMPANY).alias("company"), F.concat(pick(PARTS), asked).alias("body"))


POSTS = (
    f"WITH posts AS (SELECT o_orderkey, {_COMPANY} AS company, {sql.listed(PARTS)}[o_orderkey % {len(PARTS)} + 1] || replace({sql.listed(QUALIFICATIONS)}[o_orderkey % {len(QUALIFICATIONS)} + 1], '{{p}}', o_orderpriority) AS body FROM orders) "
)


def _phrases(phrases) -> str:
    each = ", ".join(f"CASE WHEN regexp_matches(body, '(^|[^\\p{{L}}\\p{{N}}_-])' || {sql.quoted(p)} || '($|[^\\p{{L}}\\p{{N}}_-])') THEN {sql.quoted(p)} END" for p in phrases)
    return f"list_filter([{each}], lambda p: p IS NOT NULL)"


_EXACT = f"CASE {sql.domain('body')} " + " ".join(f"WHEN '{d}' THEN {_phrases(sorted(set(ps)))}" for d, ps in extraction.KEYPHRASES.items()) + " END"
_IMPLIED = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(body, {sql.quoted('(?i)(?:' + p + ')')}) THEN {sql.quoted(n)} END" for n, p in extraction.IMPLIED.items()) + "], lambda p: p IS NOT NULL)"
_BUS = f"CASE WHEN {sql.domain('body')} IN ('software', 'defense') AND regexp_matches(body, {sql.quoted(extraction.BUS)}) THEN {sql.listed(extraction.BUS_SKILLS)} ELSE [] END"
_SINGLE = "list_transform(" + _phrases(extraction.KEYWORDS) + ", lambda w: array_to_string(list_transform(string_split(w, ' '), lambda x: upper(x[1]) || x[2:]), ' '))"


@query(
    "skills_found",
    POSTS + f"""SELECT o_orderkey, array_to_string(list_sort(one), '|') AS exact, array_to_string(list_sort(two), '|') AS implied, CASE WHEN len(one) + len(two) < {extraction.FEW} THEN array_to_string(list_sort(list_filter(single, lambda x: NOT list_contains(one, x) AND NOT list_contains(two, x))), '|') ELSE '' END AS single
  FROM (SELECT o_orderkey, one, list_filter(list_distinct(list_concat(implied, bus)), lambda x: NOT list_contains(one, x)) AS two, single FROM (SELECT o_orderkey, {_EXACT} AS one, {_IMPLIED} AS implied, {_BUS} AS bus, {_SINGLE} AS single FROM posts))""",
    views=False,
)
def _(v):
    found = posts(v).select("o_orderkey", extraction.skills(F.col("body")).alias("s"))
    of = lambda m: F.array_join(F.array_sort(F.transform(F.filter("s", lambda x: x["method"] == m), lambda x: x["value"])), "|")
    return found.select("o_orderkey", of("keyphrase_exact").alias("exact"), of("context_inferred").alias("implied"), of("skill_keyword").alias("single"))


def _section(names: str, ends: str) -> str:
    return f"regexp_extract(body, '(?is)(?:#{{2,3}}\\s+)?(?:{names})[\\s\\n:]*(.+?)(?:\\n#{{2,3}}|{ends}|---|\\z)', 1)"


def _items(section: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({section}, '[*•\\-]\\s+(.+?)(?:\\n|$)', 1), lambda x: trim(x, ' ')), lambda x: length(x) > 10 AND length(x) < 150)"


def _own(items: str) -> str:
    return f"list_filter({items}, lambda x: NOT regexp_matches(x, '(?i)^\\d+\\+?\\s+years\\s+of\\s+experience\\s*$'))"


def _years(words: str, joined: str) -> str:
    pattern = f"{extraction.YEARS}(?:\\s+(?:{words})\\s+([^.\\n]+))?"
    of = f"regexp_replace(trim(regexp_extract(x, '{pattern}', 2), ' '), '[.,;]+$', '')"
    return f"list_filter(list_transform(regexp_extract_all(body, '{pattern}'), lambda x: CASE WHEN {of} <> '' THEN regexp_extract(x, '{pattern}', 1) || '+ years of experience {joined}' || {of} END), lambda x: x IS NOT NULL)"


def _stated(*conditions: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(body, {sql.quoted(p)}) THEN {sql.quoted(n)} END" for p, n in conditions) + "], lambda x: x IS NOT NULL)"


_SPACE = f"list_concat({_own(_items(_section('(?:minimum|required)\\s+(?:qualifications?|experience)', 'Preferred')))}, {_years('in|with|focused\\s+on', 'in ')}, {_stated(('(?i)background\\s+check|security\\s+clearance', extraction.STANDARD_CHECK), ('(?i)U\\.S\\.\\s+(?:citizen|national)', extraction.CITIZEN))})"
_AIRCRAFT = f"list_concat({_own(_items(_section('(?:basic|minimum|required)\\s+(?:qualifications?|skills/experience)', 'Preferred|Travel')))}, {_years('in|with|using|focused\\s+on', '')}, {_stated((extraction.BACHELOR, extraction.DEGREE), ('(?i)Top\\s+Secret', extraction.CLEARANCE), ('(?i)U\\.S\\.\\s+Person|export\\s+control', extraction.PERSON), ('(?i)CodeVue|coding\\s+challenge', extraction.CODING), ('(?i)drug', extraction.DRUG))}, list_transform({_items(_section('(?:preferred|desired)\\s+(?:qualifications?|experience)', 'Travel|Background'))}, lambda x: x || ' (Preferred)'))"
_BASIC, _LEAST = _section("basic\\s+qualifications", "Preferred"), _section("minimum\\s+qualifications", "Preferred")
_ANY = _own(_items(f"CASE WHEN {_BASIC} <> '' THEN {_BASIC} ELSE {_LEAST} END"))


@query(
    "company_requirements",
    POSTS + f"""SELECT o_orderkey, array_to_string(list_sort(list_distinct(CASE lower(trim(company, ' ')) WHEN 'boeing' THEN {_AIRCRAFT} WHEN 'blue origin' THEN {_SPACE}
    ELSE list_concat({_ANY}, CASE WHEN regexp_matches(body, '(?i)degree|bachelor|master') AND len(list_filter({_ANY}, lambda x: contains(lower(x), 'degree'))) = 0 THEN ['Bachelor''s Degree or equivalent'] ELSE [] END) END)), '|') AS found FROM posts""",
    views=False,
)
def _(v):
    return posts(v).select("o_orderkey", F.array_join(F.array_sort(F.array_distinct(extraction.company_requirements(F.col("body"), F.col("company")))), "|").alias("found"))


_PARTS = [_section(names, "Preferred") for names in ("basic\\s+qualifications", "minimum\\s+qualifications", "required\\s+skills", "required\\s+skills/experience")]
_SPAN = f"{extraction.YEARS}(?:\\s+(?:in|with|focused\\s+on|involving|related\\s+to|using)\\s+([^.\\n]+))?"
_OF = f"regexp_replace(trim(regexp_extract(x, '{_SPAN}', 2), ' '), '[.,;]+$', '')"
_ALL_YEARS = "list_concat(" + ", ".join(f"list_transform(regexp_extract_all({p}, '{_SPAN}'), lambda x: regexp_extract(x, '{_SPAN}', 1) || '+ years of experience' || CASE WHEN {_OF} <> '' THEN ' ' || {_OF} ELSE '' END)" for p in _PARTS[:3]) + ")"
_BULLETS = "list_concat(" + ", ".join(f"list_filter({_items(p)}, lambda x: NOT regexp_matches(x, '^\\d+\\+') AND NOT contains(lower(x), 'years of experience'))" for p in (_PARTS[0], _PARTS[1], _PARTS[3])) + ")"
_WISHED = f"list_transform({_items(_section('(?:preferred|desired)\\s+(?:qualifications?|experience)', 'Background'))}, lambda x: CASE WHEN contains(x, '(Preferred)') THEN x ELSE x || ' (Preferred)' END)"
_FOUND = f"SELECT o_orderkey, body, list_concat({_ALL_YEARS}, {_BULLETS}, {_WISHED}) AS f FROM posts"
for _p, _names, _value, _low in (
    ("(?i)U\\.S\\.\\s+(?:citizen|national)|permanent\\s+resident", ["U.S. citizen"], extraction.CITIZEN, False),
    ("(?i)background\\s+check", ["Background Check"], extraction.STANDARD_CHECK, False),
    ("(?i)drug", ["drug"], extraction.DRUG, True),
    ("(?i)CodeVue|coding\\s+challenge|technical.*assessment", ["codevue", "coding"], extraction.CODING, True),
    (extraction.BACHELOR, ["Bachelor", "Degree"], extraction.DEGREE, False),
):
    _has = " OR ".join(f"contains({'lower(x)' if _low else 'x'}, '{n}')" for n in _names)
    _FOUND = f"SELECT o_orderkey, body, CASE WHEN regexp_matches(body, {sql.quoted(_p)}) AND len(list_filter(f, lambda x: {_has})) = 0 THEN list_append(f, {sql.quoted(_value)}) ELSE f END AS f FROM ({_FOUND})"


@query("stated_requirements", POSTS + f"SELECT o_orderkey, array_to_string(list_sort(list_distinct(f)), '|') AS found FROM ({_FOUND})", views=False)
def _(v):
    return posts(v).select("o_orderkey", F.array_join(F.array_sort(extraction.stated_requirements(F.col("body"))), "|").alias("found"))


@query("entities_with_confidence")
def _(v):
    found = extraction.with_entities(posts(v), "body", "company").drop("body", "company")
    return found.withColumns({k: F.to_json(k) for k in ("skills", "technologies", "requirements")})


#: Markdown of four sections; the last is passed over.
MD = ["# Job\n## Technical Skills\n- Python and SQL\n- 5+ years of it\n- abc\n* ", " tools\nUses Docker daily\n## Requirements\n1. Know ", " well\n- one, two, three\n## About the role\nRust and Go\n## Responsibilities\n- Run kubernetes clusters\n## Benefits\n- Java beans and tea"]


def _in(k: str, words) -> str:
    return "(" + " OR ".join(f"contains({k}, '{w}')" for w in words) + ")"


_ROUTED = f"SELECT o_orderkey, unnest(regexp_split_to_array({sql.quoted(MD[0])} || o_orderpriority || {sql.quoted(MD[1])} || o_orderstatus || {sql.quoted(MD[2])}, '(?m)^#+\\s*')) AS part FROM orders"
_NAMED = "CASE " + " ".join(f"WHEN {_in('low', ws)} THEN '{n}'" for n, ws in rules.SECTION_WORDS) + " ELSE replace(low, ' ', '_') END"
_KEPT = f"SELECT o_orderkey, key, body FROM (SELECT *, {_NAMED} AS key FROM (SELECT o_orderkey, lower(trim(split_part(part, chr(10), 1), ' ')) AS low, part[strpos(part, chr(10)) + 1:] AS body FROM ({_ROUTED}) WHERE contains(part, chr(10)))) WHERE NOT {_in('replace(key, chr(95), chr(32))', extraction.SKIPPED_SECTIONS)} AND trim(body, ' ' || chr(10)) <> ''"
_LISTED = f"list_filter(list_transform(regexp_extract_all(body, '(?m)^(?:[*\\-+]|\\d+\\.)\\s+(.+)$', 1), lambda x: trim(x, ' ')), lambda x: length(x) > 3 AND NOT regexp_matches(x, {sql.quoted(extraction.MEASURES)}) AND len(string_split(x, ',')) < 3)"
_WORDS = f"list_filter({sql.found_words('body', extraction.lexicons.terms(extraction.lexicons.TECHNOLOGY))}, lambda w: length(w) > 2)"


@query(
    "routed_entities",
    f"""SELECT o_orderkey, {", ".join(f"coalesce(array_to_string(list_sort(list_distinct(flatten(list({n})))), '|'), '') AS {n}" for n in ("skills", "technologies", "requirements"))} FROM (
  SELECT o_orderkey, CASE WHEN {_in('key', extraction.SKILL_SECTIONS)} THEN {_LISTED} ELSE [] END AS skills, CASE WHEN {_in('key', extraction.REQUIREMENT_SECTIONS)} AND NOT {_in('key', extraction.SKILL_SECTIONS)} THEN {_LISTED} ELSE [] END AS requirements,
    CASE WHEN {_in('key', extraction.SKILL_SECTIONS + extraction.DESCRIPTION_SECTIONS)} OR key = 'responsibilities' THEN {_WORDS} ELSE [] END AS technologies FROM ({_KEPT})) GROUP BY o_orderkey""",
    views=False,
)
def _(v):
    md = F.concat(F.lit(MD[0]), "o_orderpriority", F.lit(MD[1]), "o_orderstatus", F.lit(MD[2]))
    found = v.spread("orders").select("o_orderkey", extraction.routed(md).alias("r"))
    return found.select("o_orderkey", *[F.array_join(f"r.{n}", "|").alias(n) for n in ("skills", "technologies", "requirements")])


def _normal(x: str) -> str:
    """As extraction.normal_requirement has it, for requirements without an advanced degree."""
    sub = lambda y, pattern, by: f"regexp_replace({y}, {sql.quoted(pattern)}, {sql.quoted(by)}, 'g')"
    out = f"trim(replace(trim({x}, ' '), '(Preferred)', ''), ' ')"
    for pattern, by in extraction.TRIMMED:
        out = sub(out, pattern, by)
    out = f"(SELECT CASE WHEN regexp_matches(y, '(?i)^Experience\\s+in\\s+development,\\s+implementation,\\s+and') THEN {sub(sub('y', '(?i)development,\\s+', ''), '(?i),\\s+and\\s+', ' and ')} WHEN regexp_matches(y, '(?i)^Experience\\s+in\\s+development\\s+and') THEN {sub('y', '(?i)development\\s+and\\s+', '')} ELSE y END FROM (SELECT {out} AS y))"
    for pattern, by in rules.PLAINER:
        out = sub(out, pattern, by)
    return f"(SELECT trim(CASE WHEN lower(z) = 'experience in development' THEN '' WHEN contains({x}, '(Preferred)') THEN z || ' (Preferred)' ELSE z END, ' ') FROM (SELECT {sub(out, '\\s*\\(HIL\\)', '')} AS z))"


_RAW = "CASE o_orderkey % 3 WHEN 0 THEN concat('Demonstrated experience in  avionics as well as ', o_orderpriority, ', simulations, and software (e.g. x) (Preferred)') WHEN 1 THEN concat('Experience in development, implementation, and testing of ', o_orderstatus, ' on fast-paced projects') ELSE concat('Knows  ', o_orderpriority, ' , rigs (HIL)') END"


@query("normal_requirements", f"SELECT o_orderkey, {_normal('t')} AS normal FROM (SELECT o_orderkey, {_RAW} AS t FROM orders)", views=False)
def _(v):
    return v.table("orders").select("o_orderkey", extraction.normal_requirement(F.expr(_RAW)).alias("normal"))


__all__ = ["posts", "requirements"]
