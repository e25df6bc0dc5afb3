"""Queries that SQL can't say, against plain Python over the whole small tables."""

import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from millrace.functions import boilerplate, extraction, text
from millrace.operators import requirements
from millrace.plans import QUERIES
from millrace.plans.entities import posts
from millrace.plans.texts import said
from millrace.plans.adapters import Views
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def pages(spark):
    return {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}


@pytest.fixture(scope="module")
def mds(spark):
    return {r["page_id"]: r["md"] for r in QUERIES["html_markdown"](spark, SMALL).collect()}


def headed(md):
    """Headers synthesised line by line, then dividers."""
    lines = md.split("\n")
    for i, line in enumerate(lines):
        bare = line.strip(" ")
        bold = re.fullmatch(r"\*\*(.+?)\*\*", bare)
        label = (bold[1] if bold else bare).strip(" ").rstrip(":").strip(" ")
        if label.replace("’", "'").lower() in text.HEADERS:
            lines[i] = f"## {label}"
    for i, line in enumerate(lines):
        m = re.match(r"[ \t]*\*\*[ \t]*(?!\*)([^*\n]+?)[ \t]*:?[ \t]*\*\*", line)
        after = next((x.strip() for x in lines[i + 1 :] if x.strip()), "#")
        if m and not after.startswith("#"):
            lines[i] = f"### {m[1]}"
    for i, line in enumerate(lines):
        bare = line.strip(" ")
        if re.fullmatch(r"[^#*+\-•|>].*:", bare):
            lines[i] = "### " + bare[:-1]
    out = []
    for i, line in enumerate(lines):
        out += ["", "---", line] if i and re.match(r"#{2,3}\s", line) else [line]
    return re.sub(r"(?m)(?:^---\n\s*)+^---$", "---", "\n".join(out))


def test_structured_markdown(spark, mds):
    got = {r["page_id"]: r["md"] for r in QUERIES["structured_markdown"](spark, SMALL).collect()}
    assert got == {k: headed(v) for k, v in mds.items()}


def test_polished_markdown(spark, mds):
    def polish(md):
        md = "\n".join(line.rstrip(" ") for line in md.split("\n"))
        md = re.sub(r"(?m)(^\s*[-*+] .*)\n\n(?=\s*[-*+] )", r"\1\n", md)
        md = re.sub(r"(?m)(?<!\n\n)(?<!\A)^(#{1,6} .*)$", r"\n\1", md)
        md = re.sub(r"(?m)^(#{1,6} .*)\n(?!\n)", r"\1\n\n", md)
        md = re.sub(r"(?m)^(?!\s*[-*+] )(?!#)(\S.*)\n(?=\s*[-*+] )", r"\1\n\n", md)
        return re.sub(r"\n{3,}", "\n\n", md)

    got = {r["page_id"]: r["md"] for r in QUERIES["polished_markdown"](spark, SMALL).collect()}
    assert got == {k: polish(v) for k, v in mds.items()}


def cleaned(html):
    out = re.sub(r"\s+(?:data|aria)-[\w-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", html)
    for tag, by in (("dt", "div"), ("dd", "p")):
        out = re.sub(rf"(?i)</{tag}>", f"</{by}>", re.sub(rf"(?i)<{tag}\b[^>]*>", f"<{by}>", out))
    out = re.sub(r":(?:\s*[Rr]\d+|[A-Za-z0-9_]+\d+|\d{4,})", "", out)
    out = re.sub(r"<([A-Za-z0-9_]+)[^>]*>\s*</\1>", "", re.sub(r">\s*:\s*<", "><", out))
    out = re.sub(r"(?s)<!--.*?-->", "", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", out))
    out = re.sub(r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr|ul|ol|article|section|header|footer|nav|title)\s*>", "\n", out)
    out = re.sub(r"<[^>]*>", "", out)
    for k, v in {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}.items():
        out = out.replace(k, v)
    out = re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[ \t\x0B\f\r]+", " ", out)).strip(" \n")
    for patterns in boilerplate.CATALOG.values():
        for p in patterns:
            out = re.sub(p, " " if p in boilerplate.SPACES else "", out)
    for k, v in {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}.items():
        out = out.replace(k, v)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", re.sub(r"&#\d+;", "", out))).strip(" \t\n\r")


def test_clean_html(spark, pages):
    got = {r["page_id"]: r["clean"] for r in QUERIES["clean_html"](spark, SMALL).collect()}
    assert got == {k: cleaned(v) for k, v in pages.items()}


def sentences(x):
    ends = "|".join(re.escape(a) + r"\." for a in text.ABBREVIATIONS)
    parts, at = [], 0
    for m in re.finditer(r"\s+", x):
        before = x[at : m.start()]
        if before[-1:] in (".", "!", "?") and not re.search(rf"\b(?:{ends})$", before):
            parts.append(before)
            at = m.end()
        elif "\n" in m.group():
            parts.append(before)
            at = m.end()
    return [p.strip(" ") for p in [*parts, x[at:]] if p.strip(" ")]


def test_preprocessed_jobs(spark, pages):
    rows = QUERIES["preprocessed_jobs"](spark, SMALL).collect()
    got = sorted((r["n_sentences"], r["n_chunks"], r["token_count"]) for r in rows)
    want = []
    for html in pages.values():
        title = re.search(r"(?s)<title>(.*?)</title>", html)
        body = "\n".join(x for x in (title and title[1], "Remote", cleaned(html)) if x)
        parts, chunks, held = sentences(body), [], 0
        for s in parts:
            n = len(s.split())
            if held and held + n > 100:
                held = 0
            if not held:
                chunks.append(0)
            chunks[-1] += n
            held += n
        want.append((len(parts), len(chunks), sum(max(1, int(n * 1.3)) for n in chunks)))
    assert got == sorted(want)


def test_requirement_spans(spark):
    """Phrases by trying every pattern on every sentence, without the words that are looked for first."""
    rows = said(Views(spark, SMALL)).collect()
    got = {}
    for r in QUERIES["requirement_spans"](spark, SMALL).collect():
        got.setdefault((r["id"], r["part"]), set()).add((r["text"], r["trigger_word"], r["confidence"]))
    want = {}
    for r in rows:
        s, best = r["sentence"], {}
        ends = [m.end() for m in re.finditer(r"[^.!?\n]*[.!?\n]?", s) if m.group()]
        for trigger, pattern, base in requirements.PHRASES:
            for m in re.finditer(pattern, s, re.I):
                found = m[1].strip()
                b = next((e for e in ends if m.start(1) < e), len(s))
                a = max([e for e in ends if e <= m.start(1)], default=0)
                near = s[max(a, m.start(1) - 50) : min(b, m.start(1) + len(m[1].rstrip()) + 50)]
                score = base - 0.15 * bool(re.search(r"\bif\b", s[a:b], re.I)) - 0.25 * bool(re.search(r"nice\s+to\s+have", found, re.I))
                score = 0.0 if re.search(requirements.NEGATED, near) else round(min(1.0, max(0.0, score)), 3)
                rank = (score, sum(c.isupper() for c in found), -m.start(1))
                if score > 0 and found and rank > best.get(found.lower(), ((-1, 0, 0),))[0]:
                    best[found.lower()] = (rank, (found, trigger, score))
        if best:
            want.setdefault((r["id"], r["part"]), set()).update(x for _, x in best.values())
    assert got == want and len(want) > 1000


def test_fuzzy_dedup(spark):
    """No two kept texts are alike, and each dropped one is like a kept one."""
    from millrace.operators import similarity

    whole = {r["id"]: r["s"] for r in said(Views(spark, SMALL)).groupBy("id").agg(F.collect_list("sentence").alias("s")).collect()}
    for r in QUERIES["fuzzy_dedup"](spark, SMALL).collect():
        kept = r["kept"]
        for i, a in enumerate(kept):
            assert all(SequenceMatcher(None, similarity.comparable(a), similarity.comparable(b)).ratio() < 0.8 or similarity.likeness(a, b) < 0.8 for b in kept[:i])
        assert all(x in kept or any(similarity.likeness(x, k) >= 0.8 or similarity.likeness(k, x) >= 0.8 for k in kept) for x in whole[r["id"]])


def test_stated_requirements(spark):
    got = {r["o_orderkey"]: set(filter(None, r["found"].split("|"))) for r in QUERIES["stated_requirements"](spark, SMALL).collect()}

    def section(body, names, ends="Preferred"):
        m = re.search(rf"(?is)(?:#{{2,3}}\s+)?(?:{names})[\s\n:]*(.+?)(?=\n#{{2,3}}|{ends}|---|\Z)", body)
        return m[1] if m else ""

    def items(part):
        return [x.strip() for x in re.findall(r"[*•\-]\s+(.+?)(?:\n|$)", part) if 10 < len(x.strip()) < 150]

    for r in posts(Views(spark, SMALL)).collect():
        body, out = r["body"], set()
        for names in (r"basic\s+qualifications", r"minimum\s+qualifications", r"required\s+skills"):
            for n, of in re.findall(r"(?i)(\d+)\+?\s+years\s+(?:of\s+)?experience(?:\s+(?:in|with|focused\s+on|involving|related\s+to|using)\s+([^.\n]+))?", section(body, names)):
                out.add(f"{n}+ years of experience {of.strip().rstrip('.,;')}".strip())
        for names in (r"basic\s+qualifications", r"minimum\s+qualifications", r"required\s+skills/experience"):
            out |= {x for x in items(section(body, names)) if not re.match(r"\d+\+", x) and "years of experience" not in x.lower()}
        out |= {x if "(Preferred)" in x else f"{x} (Preferred)" for x in items(section(body, r"(?:preferred|desired)\s+(?:qualifications?|experience)", "Background"))}
        for pattern, names, value in (
            (r"(?i)U\.S\.\s+(?:citizen|national)|permanent\s+resident", ["U.S. citizen"], extraction.CITIZEN),
            (r"(?i)background\s+check", ["Background Check"], extraction.STANDARD_CHECK),
            (r"(?i)drug", ["drug"], extraction.DRUG),
            (r"(?i)CodeVue|coding\s+challenge|technical.*assessment", ["codevue", "coding"], extraction.CODING),
            (extraction.BACHELOR, ["Bachelor", "Degree"], extraction.DEGREE),
        ):
            low = names[0].islower()
            if re.search(pattern, body) and not any(n in (x.lower() if low else x) for x in out for n in names):
                out.add(value)
        assert got[r["o_orderkey"]] == out, body


def test_entities_with_confidence(spark):
    import json

    rows = QUERIES["entities_with_confidence"](spark, SMALL).collect()
    names = {r["o_orderkey"]: set(filter(None, (r["exact"] + "|" + r["implied"] + "|" + r["single"]).split("|"))) for r in QUERIES["skills_found"](spark, SMALL).collect()}
    for r in rows:
        found = json.loads(r["skills"])
        assert {x["value"] for x in found} == names[r["o_orderkey"]]
        for k in ("skills", "technologies", "requirements"):
            values = [x["confidence"] for x in json.loads(r[k])]
            mean = sum(values) / len(values) if values else 0.0
            assert abs(r[f"avg_{k}_confidence"] - mean) <= 0.0051 and all(0 < c <= 0.95 for c in values)


def test_batch_report(spark, pages):
    got = QUERIES["batch_report"](spark, SMALL).collect()
    n = 0
    for html in pages.values():
        title = re.search(r"(?s)<title>(.*?)</title>", html)
        body = "\n".join(x for x in (title and title[1], "Remote", cleaned(html)) if x).lower()
        n += not any(m in body for m in text.RAW_HTML)
    assert len(got) == 1 and re.match(r"# Assessments\n\n## Top 10\n\n### ", got[0]["report"]) and got[0]["report"].count("- Score: ") == 10 and f"{n} assessments" in got[0]["report"]
