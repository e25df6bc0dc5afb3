"""Pieces of DuckDB's SQL that say what columns of functions/ and operators/ say."""

from __future__ import annotations

from millrace.functions import boilerplate, lexicons, text
from millrace.operators import requirements


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


def sentences(t: str) -> str:
    """List of sentences: dots of abbreviations are hidden while the text is cut."""
    names = "|".join(a.replace(".", r"\.") for a in text.ABBREVIATIONS)
    hidden = f"regexp_replace(coalesce({t}, ''), '\\b({names})\\.', '\\1' || chr(1), 'g')"
    cut = rf"regexp_replace(regexp_replace({hidden}, '([.!?])\s+', '\1' || chr(2), 'g'), '\n+', chr(2), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(2)), lambda z: trim(replace(z, chr(1), '.'), ' ')), lambda z: z <> '')"


def words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '\\s+'), lambda y: y <> '')"


def chunks(parts: str, target: int) -> str:
    """List of chunks of a list of sentences, by a fold whose chunks stand between marks."""
    held = f"list_transform({parts}, lambda s: {{'s': s, 'n': len({words('s')})::BIGINT}})"
    step = f"CASE WHEN a.n > 0 AND a.n + x.n > {target} THEN {{'s': a.s || chr(3) || x.s, 'n': x.n}} ELSE {{'s': CASE WHEN a.s = '' THEN x.s ELSE a.s || ' ' || x.s END, 'n': a.n + x.n}} END"
    return f"list_filter(string_split(list_reduce({held}, lambda a, x: {step}, {{'s': '', 'n': 0::BIGINT}}).s, chr(3)), lambda z: z <> '')"


def classified(rows: str) -> str:
    """Rows of a subquery with a column sentence, and trigger, confidence and priority of the best trigger; others are left out."""
    order = sorted(range(len(requirements.TRIGGERS)), key=lambda i: (requirements.TRIGGERS[i][3], -requirements.TRIGGERS[i][2], i))
    each = [(i, *requirements.TRIGGERS[i]) for i in order]
    case = lambda make: "CASE best " + " ".join(f"WHEN {i} THEN {make(t, p, c, k)}" for i, t, p, c, k in each) + " END"
    first = "CASE " + " ".join(f"WHEN regexp_matches(sentence, {quoted('(?i)' + p)}) THEN {i}" for i, _, p, _, _ in each) + " END"
    at = case(lambda t, p, c, k: f"length(regexp_extract(sentence, {quoted('(?is)^(.*?)(?:' + p + ')')}, 1)) + 1")
    near = f"substr(sentence, greatest(pos - {requirements.NEAR}, 1), {2 * requirements.NEAR + 20})"
    score = "base - CASE WHEN contains(sentence, '(') THEN 0.10 ELSE 0 END - CASE WHEN regexp_matches(sentence, '(?i)\\bif\\b') THEN 0.15 ELSE 0 END - CASE WHEN regexp_matches(sentence, '(?i)nice\\s+to\\s+have') THEN 0.25 ELSE 0 END + CASE WHEN len(regexp_extract_all(sentence, '\\b[A-Z]{2,}\\b')) > 2 THEN 0.05 ELSE 0 END"
    marked = f"SELECT *, {case(lambda t, p, c, k: quoted(t))} AS \"trigger\", {case(lambda t, p, c, k: str(c))}::DOUBLE AS base, {case(lambda t, p, c, k: str(k))} AS priority, {at} AS pos FROM (SELECT *, {first} AS best FROM ({rows})) WHERE best IS NOT NULL"
    scored = f"SELECT *, round(greatest(0, least(1, {score})), 3)::DOUBLE AS confidence FROM ({marked}) WHERE NOT regexp_matches({near}, {quoted(requirements.NEGATED)})"
    return f"SELECT * EXCLUDE (best, base, pos) FROM ({scored}) WHERE confidence > 0"


def found_words(t: str, terms) -> str:
    """Sorted words of a list that a text has."""
    pattern = r"[\p{L}\p{N}][\p{L}\p{N}+#.-]*[\p{L}\p{N}+#]|[\p{L}\p{N}]"
    return f"list_sort(list_filter(list_distinct(regexp_extract_all(lower({t}), '{pattern}')), lambda w: list_contains({listed(sorted(set(terms)))}, w)))"


def found_phrases(t: str, phrases) -> str:
    """Sorted phrases of a list that stand in a text between words' ends."""
    each = ", ".join(f"CASE WHEN regexp_matches(lower({t}), '(^|[^\\p{{L}}\\p{{N}}_-])' || {quoted(p)} || '($|[^\\p{{L}}\\p{{N}}_-])') THEN {quoted(p)} END" for p in sorted(set(phrases)))
    return f"list_filter([{each}], lambda p: p IS NOT NULL)"


def domain(t: str) -> str:
    """Domain with the most signals; the first of equals."""
    sums = {n: "(" + " + ".join(f"regexp_matches(lower({t}), {quoted('(?i)' + p)})::INT" for p in ps) + ")" for n, ps in lexicons.DOMAINS.items()}
    best = f"greatest({', '.join(sums.values())})"
    return f"CASE WHEN {best} = 0 THEN 'general' " + " ".join(f"WHEN {s} = {best} THEN '{n}'" for n, s in sums.items()) + " END"


#: What the tags of the test pages become in Markdown; all others go.
_TAGS = [
    (r"</?(?:p|div|article|footer|nav|title|body)\b[^>]*>", "chr(10) || chr(10)"),
    (r"<h1[^>]*>", "chr(10) || chr(10) || '# '"),
    (r"</(?:h1|ul|head|html)>", "chr(10) || chr(10)"),
    (r"<ul[^>]*>", "chr(10)"),
    (r"<li[^>]*>", "chr(10) || '- '"),
    (r"</?b>", "'**'"),
    (r"<br>", "chr(10)"),
]


def markdown(html: str) -> str:
    """Markdown of the test pages: tags by what they stand for, then references, lines trimmed, no more than one blank line."""
    x = html
    for pattern in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->", r"<!DOCTYPE[^>]*>"):
        x = f"regexp_replace({x}, '{pattern}', '', 'g')"
    x = rf"regexp_replace({x}, '\s+', ' ', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '<a href=\"([^\"]*)\">(.*?)</a>', '[\2](\1)', 'g'), '</head>|</html>', '', 'g')"
    for pattern, by in _TAGS:
        x = rf"regexp_replace({x}, '{pattern}', {by}, 'g')"
    x = rf"regexp_replace({x}, '<[^>]*>|<[a-zA-Z/!][^>]*$', '', 'g')"
    for name, by in {"copy": "©", "middot": "·", "lt": "<", "gt": ">", "quot": '"', "nbsp": " ", "amp": "&"}.items():
        x = f"replace({x}, '&{name};', {quoted(by)})"
    x = rf"regexp_replace(regexp_replace({x}, '\*\*\s*\*\*|\[\s*\]\([^)]*\)', '', 'g'), '(?m)^[ \t]+|[ \t]+$', '', 'g')"
    return rf"trim(regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"


def sections(md: str) -> str:
    """List of what stands between headers and bold lines."""
    return rf"list_filter(list_transform(string_split(regexp_replace({md}, '(?m)^(#{{1,3}}\s|\*\*.+\*\*\s*$)', chr(1) || '\1', 'g'), chr(1)), lambda z: trim(z, ' ' || chr(10))), lambda z: z <> '')"


def structured(md: str) -> str:
    """Markdown with header phrases, bold lines and lines that end in a colon as headers, by lists of lines; then dividers."""
    bare = "regexp_replace(trim(CASE WHEN regexp_matches(trim(l, ' '), '^\\*\\*.+?\\*\\*$') THEN regexp_extract(trim(l, ' '), '^\\*\\*(.+?)\\*\\*$', 1) ELSE trim(l, ' ') END, ' '), ':+$', '')"
    one = f"list_transform(string_split({md}, chr(10)), lambda l: CASE WHEN list_contains({listed(text.HEADERS)}, lower(replace({bare}, '’', chr(39)))) THEN '## ' || trim({bare}, ' ') ELSE l END)"
    label = r"regexp_extract(l, '^[ \t]*\*\*[ \t]*([^*\n]+?)[ \t]*:?[ \t]*\*\*.*$', 1)"
    after = "coalesce(list_filter(ls[i + 1:], lambda z: trim(z, ' ' || chr(9)) <> '')[1], '#')"
    two = f"list_transform(ls, lambda l, i: CASE WHEN {label} <> '' AND NOT starts_with(trim({after}, ' ' || chr(9)), '#') THEN '### ' || {label} ELSE l END)"
    three = r"list_transform(ms, lambda l: CASE WHEN regexp_matches(trim(l, ' '), '^[^#*+\-•|>].*:$') THEN '### ' || regexp_replace(trim(l, ' '), ':$', '') ELSE l END)"
    four = r"array_to_string(list_transform(ns, lambda l, i: CASE WHEN i > 1 AND regexp_matches(l, '^#{2,3}\s') THEN chr(10) || '---' || chr(10) || l ELSE l END), chr(10))"
    return f"(SELECT regexp_replace({four}, '(?m)(?:^---\\n\\s*)+^---$', '---', 'g') FROM (SELECT {three} AS ns FROM (SELECT {two} AS ms FROM (SELECT {one} AS ls))))"


def polished(md: str) -> str:
    """Markdown after the five rules of the polisher, by lists of lines."""
    item, head = r"'^\s*[-*+] '", "'^#{1,6} '"
    lines = lambda x: f"string_split({x}, chr(10))"
    joined = lambda x: f"array_to_string({x}, chr(10))"
    a = f"list_transform({lines(md)}, lambda l: rtrim(l, ' '))"
    b = f"list_filter(a, lambda l, i: NOT (l = '' AND i > 1 AND i < len(a) AND regexp_matches(a[i - 1], {item}) AND regexp_matches(a[i + 1], {item})))"
    c = f"list_transform(b, lambda l, i: CASE WHEN i > 1 AND regexp_matches(l, {head}) AND b[i - 1] <> '' THEN chr(10) || l ELSE l END)"
    d = f"list_transform(c, lambda l, i: CASE WHEN i < len(c) AND regexp_matches(l, {head}) AND c[i + 1] <> '' THEN l || chr(10) ELSE l END)"
    e = f"list_transform(d, lambda l, i: CASE WHEN i < len(d) AND regexp_matches(l, '^\\S') AND NOT starts_with(l, '#') AND NOT regexp_matches(l, {item}) AND regexp_matches(d[i + 1], {item}) THEN l || chr(10) ELSE l END)"
    out = f"SELECT {a} AS a"
    for name, x, before in (("b", b, "a"), ("c", c, "b")):
        out = f"SELECT {x} AS {name} FROM ({out})"
    out = f"SELECT {lines(joined('c'))} AS c FROM ({out})"
    out = f"SELECT {lines(joined(d))} AS d FROM ({out})"
    return f"(SELECT regexp_replace({joined(e)}, '\\n{{3,}}', chr(10) || chr(10), 'g') FROM ({out}))"


def cleaned(html: str) -> str:
    """Plain text of the test pages' HTML without boilerplate; of their empty elements, those of the tags that they have."""
    sub = lambda x, p, by="''": f"regexp_replace({x}, {quoted(p)}, {by}, 'g')"
    x = sub(f"coalesce({html}, '')", r"""\s+(?:data|aria)-[\w-]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""")
    x = sub(sub(x, r":(?:\s*[Rr]\d+|\w+\d+|\d{4,})"), r">\s*:\s*<", "'><'")
    for tag in ("p", "div", "li", "a", "b", "h1"):
        x = sub(x, rf"<{tag}\b[^>]*>\s*</{tag}>")
    for p in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->"):
        x = sub(x, p)
    x = sub(sub(x, r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr|ul|ol|article|section|header|footer|nav|title)\s*>", "chr(10)"), "<[^>]*>")
    named = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
    for k, v in named.items():
        x = f"replace({x}, '{k}', {quoted(v)})"
    x = f"trim({sub(sub(x, r'[ \t\x0B\f\r]+', chr(39) + ' ' + chr(39)), r' ?\n[ \n]*', 'chr(10)')}, ' ' || chr(10))"
    for patterns in boilerplate.CATALOG.values():
        for p in patterns:
            x = sub(x, p.replace("(?!or|ing)", ""), "' '" if p in boilerplate.SPACES else "''")
    for k, v in boilerplate.NAMED.items():
        x = f"replace({x}, '{k}', {quoted(v)})"
    x = sub(f"replace({x}, '&amp;', '&')", r"&#\d+;")
    return f"trim({sub(sub(x, r'[ \t]+', chr(39) + ' ' + chr(39)), r'\n{3,}', 'chr(10) || chr(10)')}, ' ' || chr(9) || chr(10) || chr(13))"
