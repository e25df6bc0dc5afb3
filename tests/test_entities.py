"""Skills, requirements and routed entities of postings against small cases."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import extraction as ex


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("v")).first()["v"]


def test_skills_by_way(spark):
    got = one(spark, ex.skills(F.col("t")), t="Flight operations. Mentoring. We do unit tests and leadership planning of aerospace.")
    assert [(x["value"], x["method"]) for x in got] == [("Mentoring", "keyphrase_exact"), ("Unit testing", "context_inferred"), ("Leadership", "skill_keyword"), ("Planning", "skill_keyword")]
    assert [x["confidence"] for x in got] == [0.95, 0.70, 0.50, 0.50]
    assert one(spark, ex.skills(F.col("t")), t=None) == []
    bus = one(spark, ex.skills(F.col("t")), t="DoD weapons system with ARINC 429")
    assert set(ex.BUS_SKILLS) <= {x["value"] for x in bus}


def test_requirements_by_rules(spark):
    text = "## Basic Qualifications\n- 5+ years of experience in autonomy for aerospace\n- Works well with the whole team\n- tiny\n\n## Preferred Qualifications\n- Has shipped a product once\n---\nMS or PhD preferred. U.S. citizen. A background check, a drug test and a coding challenge. Bachelor's Degree."
    got = one(spark, ex.stated_requirements(F.col("t")), t=text)
    assert set(got) == {"5+ years of experience autonomy or aerospace autonomy/GNC", "Works well with the whole team", "Has shipped a product once (Preferred)", f"{ex.ADVANCED} (Preferred)", ex.CITIZEN, ex.STANDARD_CHECK, ex.DRUG, ex.CODING, ex.DEGREE}
    assert one(spark, ex.stated_requirements(F.col("t")), t="nothing") == [] == one(spark, ex.stated_requirements(F.col("t")), t=None)


def test_requirements_by_company(spark):
    text = "### Required Qualifications\n- Able to weld steel all day\n- 4+ years of experience\n### Preferred Qualifications\n- Likes long walks a lot\n### Travel\n5 years of experience with kites. Top Secret, drug. You should have experience with wind tunnels in winter."
    got = {x["value"]: (x["confidence"], x["method"]) for x in one(spark, ex.requirements(F.col("t"), F.col("c")), t=text, c=" BOEING")}
    assert got["Able to weld steel all day"] == (0.92, "pattern_match") and got["Likes long walks a lot (Preferred)"][1] == "pattern_match"
    assert got["5+ years of experience kites"] == (0.92, "pattern_match") and got[ex.CLEARANCE] == (0.90, "structured_bullet") and got[ex.DRUG] == (0.90, "structured_bullet")
    assert got["You should have experience with wind tunnels in winter"] == (0.75, "fallback")
    space = one(spark, ex.company_requirements(F.col("t"), F.col("c")), t="Minimum qualifications\n- Knows rockets inside out\n\n3 years experience in hydraulics, security clearance", c="blue origin")
    assert set(space) == {"Knows rockets inside out", "3+ years of experience in hydraulics, security clearance", ex.STANDARD_CHECK}
    assert one(spark, ex.company_requirements(F.col("t"), F.col("c")), t="a master of arts", c=None) == ["Bachelor's Degree or equivalent"]
    with pytest.raises(ValueError):
        ex.register_parser("Boeing", ex.any_company)


def test_normal_requirements(spark):
    cases = {
        "Demonstrated experience in X as well as Y on fast-paced projects": "Experience in X and Y",
        "Experience in development, implementation, and testing": "Experience in implementation and testing",
        "Experience in development and test rigs (HIL) (Preferred)": "Experience in test rigs (Preferred)",
        "Experience in development": "",
        "Advanced degree (M.S. or Ph.D.) (e.g. x)": "Advanced degree (M.S. or Ph.D.) (e.g. x)",
        "Knows  A , B (often)": "Knows A, B",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "r string, want string")
    for r in df.select("r", "want", ex.normal_requirement(F.col("r")).alias("got")).collect():
        assert r["got"] == r["want"], r["r"]


def test_entities_and_routing(spark):
    df = spark.createDataFrame([("Cloud infrastructure with REST. Code reviews. Docker and Python. Bachelor's Degree, drug test.", "x")], "t string, skills string")
    got = ex.with_entities(df, "t").first()
    assert got["domain"] == "software" and {x["value"] for x in got["technologies"]} == {"Docker", "Python", "REST"}
    assert got["avg_technologies_confidence"] == 0.92 and {x["value"] for x in got["requirements"]} == {ex.DEGREE, ex.DRUG}
    assert {x["value"]: x["confidence"] for x in got["skills"]} == {"Code reviews": 0.95, "Design reviews": 0.70}
    md = "# Job\n## Technical Skills\n- Python 3\n- 3-5 years\n- a, b, c\n## Requirements\n1. Know SQL well\n## Benefits\n- Java beans\n## Responsibilities\n- Keep docker running"
    got = one(spark, ex.routed(F.col("t")), t=md)
    assert (got["skills"], got["requirements"], got["technologies"]) == (["Python 3"], ["Keep docker running", "Know SQL well"], ["docker", "python"])
    assert one(spark, ex.routed(F.col("t")), t=None)["skills"] == []


def test_selectors():
    from millrace.functions import selectors as s

    page = "<div id=a class='x job'><h2> T &amp; U </h2><p>one<br>two<a class=go href='/j?x=1'>see</a></div><div class=job data-k=v7><h2>V</h2><ul><li>q</ul></div>"
    assert [s.value(page, q) for q in ("h2", ".job > h2", "#a p", "div.job[data-k^=v] h2", "li, h2", "p a.go", "h3", "div > li", "")] == ["T & U", "T & U", "onetwosee", "V", "T & U", "see", None, None, None]
    assert s.value(page, "a", "href") == "/j?x=1" and s.value(page, "ul", "html") == "<li>q" and s.value(None, "a") is None
    assert [e.tag for e in s.select(page, "div.job")] == ["div", "div"]
    for bad in ("h2:first-child", "> a", "a >", "a..b", ""):
        with pytest.raises(ValueError):
            s.parsed(bad)


def test_landed_pages_by_selectors(spark):
    from millrace.functions import selectors
    from millrace.sources import files

    rows = [("c", "http://h/list", "<div class=job><h2>A</h2><a href='/1'>x</a></div><div class=job><h2>B</h2><i>Ulm</i></div><div class=job></div>")]
    pages = spark.createDataFrame(rows, "company string, url string, html string")
    boxes = pages.select("company", "url", F.explode(selectors.contents(F.col("html"), "div.job")).alias("html"))
    got = files.landed(boxes, selectors.extractor("h2", "i", "a")).select("title", "location", "url").collect()
    assert sorted(map(tuple, got)) == [("A", "Not specified", "http://h/1"), ("B", "Ulm", "http://h/list")]


def test_calls_are_made_again_and_fail_alone(spark):
    from millrace.operators import scoring

    def ask(text):
        if text == "bad":
            raise RuntimeError("no")
        return '{"overall_score": 70, "tech_score": 60, "seniority_score": 50, "location_score": 40}' if text == "good" else "not json"

    df = spark.createDataFrame([(1, "good", "x"), (2, "bad", "x"), (3, "odd", "x"), (4, None, "x")], "id int, prompt string, reply string")
    out = scoring.scored_replies(scoring.replied(df, ask, attempts=3, pause=0.0))
    got = {r["id"]: (r["overall_score"], r["is_default"], r["attempts"], r["error"]) for r in out.collect()}
    assert got == {1: (70.0, False, 1, None), 2: (50.0, True, 3, "RuntimeError: no"), 3: (50.0, True, 1, None), 4: (50.0, True, 1, None)}


def test_phrases_of_a_whole_text(spark):
    from millrace.operators import requirements

    md = "# Acme\n\nRequired: Java. Required: java. You must have a degree in art. Nice to have tea."
    r = requirements.extracted(spark.createDataFrame([(1, md), (2, None)], "doc_id int, text string"), least=0.5).orderBy("doc_id").collect()
    assert (r[0]["company"], r[0]["requirements_count"]) == ("Acme", len(r[0]["requirements"])) and r[1]["requirements"] == []
    scores = [x["confidence"] for x in r[0]["requirements"]]
    assert scores == sorted(scores, reverse=True) and len({x["text"].lower() for x in r[0]["requirements"]}) == len(scores) and min(scores) >= 0.5
    docs = spark.createDataFrame([(1, "## Requirements\n- Must have 5+ years of Java work\n- Must have 5 years of Java work.\n- Ability to sing")], "doc_id int, text string")
    assert [requirements.by_section(docs, like=x).count() for x in (None, 0.8)] == [3, 2]
