"""Skills, technologies and requirements of a posting with the confidence of the way they were found; routing by section.

Everything is an expression; only texts that are near duplicates of each other are told apart in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import lexicons, needles, rules
from millrace.functions import text as lines
from millrace.operators import similarity

#: Confidence of each way of finding something; 0.75 stands for requirements in prose beside a company's own.
CONFIDENCE = {"keyphrase_exact": 0.95, "context_inferred": 0.70, "skill_keyword": 0.50, "pattern_match": 0.92, "structured_bullet": 0.90, "fallback": 0.65}
NARRATIVE_CONFIDENCE = 0.75
#: Phrases that name a skill, by domain.
KEYPHRASES = {
    "aerospace": [
        "Guidance and Control", "G&C algorithms", "Conceptual level design", "Post flight analysis", "Architectural decision making", "Team leadership", "Staff coaching", "Mentoring", "Technical oversight", "Collaborative skills", "Cross-functional communication", "Technical planning",
        "Software integration", "Software development", "Unit testing", "Verification and validation", "Design reviews", "Systems analysis", "Technical coaching", "Launch operations support", "Test operations support", "Hardware-in-the-loop testing", "Vehicle test campaigns",
    ],
    "software": [
        "Software architecture", "System design", "API design", "Database design", "Architecture review", "Hands-on software development", "Code reviews", "Design walkthroughs", "Technical documentation", "Binary data transformation", "Time-series data analytics", "Data collection", "Data preparation",
        "Quantitative analysis", "Statistical analysis", "Sensor data calibration", "Sensor data synchronization", "Integrity check implementation", "Engineering data interpretation", "Engineering drawing interpretation", "Storage architecture design", "Systems maintenance", "Code quality assurance",
        "Testing strategy", "Cloud service deployment", "CI/CD implementation", "Technical leadership", "Project management", "Technical coaching", "Mentoring", "Problem decomposition", "Requirements analysis", "Technical communication", "Technology evaluation",
    ],
    "defense": [
        "Software architecture", "System design", "API design", "Database design", "Hands-on software development", "Software development", "Code reviews", "Design walkthroughs", "Systems maintenance", "Technical oversight", "Binary data transformation", "Data transformation", "Time-series data analytics",
        "Sensor data calibration", "Sensor data synchronization", "Software integration", "Integration testing", "Code quality assurance", "Testing strategy", "Cloud service deployment", "Infrastructure management", "Verification and validation", "Integrity check implementation", "Engineering data interpretation",
        "Quantitative analysis", "Statistical analysis", "Problem decomposition", "Requirements analysis", "Software documentation", "Technical documentation", "Technical leadership", "Technical coaching", "Mentoring", "Project management", "Technical communication", "Cross-functional communication",
    ],
    "hardware": [
        "Formal verification", "Clock gating", "CDC analysis", "RDC analysis", "Lint checking", "Gate simulation", "Timing analysis", "Verilog design", "SystemVerilog design", "SoC design", "ASIC design", "SOC verification", "Performance optimization", "Power optimization", "DFT implementation",
        "Systems maintenance", "Technical documentation", "Technical oversight",
    ],
    "general": ["Technical leadership", "Mentoring", "Technical planning", "Software development", "Code reviews", "Design reviews", "Technical communication", "Problem decomposition", "Project management", "Technical coaching"],
}
#: Skills that a text implies by a pattern.
IMPLIED = {
    "Guidance and Control": r"guidance\s+and\s+control|G&C|guidance.*control", "G&C algorithms": r"G&C\s+algorithms|guidance.*control.*algorithm", "Conceptual level design": r"conceptual.*design", "Post flight analysis": r"post.?flight\s+analysis|post.?operation",
    "Team leadership": r"team.*leadership|lead.*team", "Staff coaching": r"coaching|coach.*staff", "Collaborative skills": r"collaborat|cross.?functional.*team", "Software integration": r"software.*integration|integrate.*software", "Unit testing": r"unit\s+test",
    "Launch operations support": r"launch.*operation", "Test operations support": r"test.*operation|operational.*test", "Cross-functional communication": r"cross.?functional|cross.?team.*communicat", "Technical oversight": r"technical.*oversight|oversee.*technical",
    "Design reviews": r"design.*review|review.*design|code\s+review", "Systems analysis": r"system.*analysis|systems.*analysis", "Architectural decision making": r"architectur.*decision", "Verification and validation": r"verif.*validat|v&v",
    "Software development": r"software\s+development|develop.*software", "Mentoring": r"mentor", "Technical planning": r"technical.*planning|planning.*technical", "System modeling": r"system.*model|model.*system", "Hardware-in-the-loop testing": r"hardware.?in.?loop|HIL.*test",
    "Vehicle test campaigns": r"vehicle.*test.*campaign|test.*campaign", "Hands-on software development": r"hands.?on.*development", "Binary data transformation": r"binary.*data.*transformation", "Integrity check implementation": r"integrity\s+check",
    "Time-series data analytics": r"time.?series.*data|data.*time.?series", "Storage architecture design": r"storage.*architecture", "Sensor data calibration": r"calibration.*sensor|sensor.*calibration", "Sensor data synchronization": r"synchronization.*sensor|sensor.*sync",
    "Technology evaluation": r"evaluat.*(?:technology|emerging)", "Code reviews": r"code\s+review", "Design walkthroughs": r"design\s+walkthrough", "Project management": r"project.*management", "Problem decomposition": r"problem\s+decomposition",
    "Engineering data interpretation": r"engineering\s+data", "Engineering drawing interpretation": r"engineering\s+drawing", "Quantitative analysis": r"quantitative\s+analysis", "Statistical analysis": r"statistical\s+analysis", "Data collection": r"data\s+collection",
    "Data preparation": r"data\s+preparation", "Cloud service deployment": r"cloud.*deployment|deploy.*cloud", "Software documentation": r"software.*documentation", "Software design": r"software.*design|design.*software", "System design": r"system.*design|design.*system",
    "Component design": r"component.*design", "API design": r"API.*design|design.*API", "Database design": r"database.*design", "Architecture review": r"architecture.*review", "Code quality assurance": r"code.*quality|quality.*code", "Testing strategy": r"testing.*strategy|strategy.*test",
    "Integration testing": r"integration.*test", "Performance testing": r"performance.*test", "Security testing": r"security.*test", "Deployment automation": r"deployment.*automat|automat.*deploy", "Infrastructure management": r"infrastructure.*management",
    "Configuration management": r"configuration.*management|SCM", "Requirements analysis": r"requirement.*analysis", "Stakeholder management": r"stakeholder.*management", "Technical documentation": r"technical.*documentation", "Knowledge transfer": r"knowledge.*transfer",
    "Software architecture": r"(?:design|architect).*software\s+system|software\s+(?:design|architect)", "Systems maintenance": r"maintain.*system|system.*maintain", "Technical communication": r"communicate.*technical|technical\s+communicat",
}
#: Skills that a data bus standard implies in software and defense postings.
BUS, BUS_SKILLS = r"(?i)\bARINC\s+\d{3}\b", ["Binary data transformation", "Integrity check implementation", "Sensor data calibration", "Time-series data analytics", "Sensor data synchronization"]
#: Words that stand for a skill where few are found otherwise, and how many are few.
KEYWORDS = ["leadership", "team leadership", "staff coaching", "mentoring", "management", "verification", "validation", "integration", "testing", "simulation", "modeling", "design", "architecture", "algorithm", "optimization", "performance", "analysis", "planning", "review", "oversight", "communication", "collaboration", "autonomy"]
FEW = 15
#: What stated conditions are called, and the patterns that state them.
CITIZEN = "U.S. citizen, national, permanent resident, refugee, or asylee status"
CODING = "Completion of the CodeVue Coding Challenge during the selection process"
DRUG = "Passing a post-offer drug test"
DEGREE = "Bachelor's Degree"
STANDARD_CHECK = "Blue's Standard Background Check"
ADVANCED = "Advanced degree (M.S. or Ph.D.) in a relevant engineering field"
CLEARANCE = "Ability to obtain a U.S. Security Clearance (requires U.S. Citizenship)"
PERSON = "U.S. Person status as defined by 22 C.F.R. §120.62 for export control compliance"
YEARS = r"(?i)(\d+)\+?\s+years\s+(?:of\s+)?experience"
BACHELOR = r"(?i)Bachelor['’‘]?s*\s+(?:Degree|of\s+Science)"
#: Words of a company's own requirement that make it a structured one.
STRUCTURED = ["bachelor", "clearance", "citizenship", "drug", "codevue", "u.s. person"]
#: Words of headers by which what stands in a section is routed; sections that are passed over.
SKILL_SECTIONS = ["skill", "technical", "core", "competency", "ability", "expertise", "proficiency"]
REQUIREMENT_SECTIONS = ["requirement", "qualif", "needed", "essential", "must", "knowledge", "experience", "responsibility", "duty", "responsibilities"]
DESCRIPTION_SECTIONS = ["description", "overview", "summary", "about"]
SKIPPED_SECTIONS = [
    "benefits", "compensation", "salary", "pay range", "401", "retirement", "insurance", "health", "dental", "vision", "pto", "vacation", "about", "company", "culture", "commitment", "team", "our", "equal opportunity", "eoe", "affirmative action", "disability", "background check", "export control",
    "security clearance", "visa", "apply", "posting date", "posted", "application close", "codevue", "shift", "location", "work location", "travel", "working condition", "fte", "temporary", "education:", "hiring practice", "bargaining", "conflict of interest", "drug free", "e-verify", "right to work",
    "safety sensitive", "technical assessment", "total rewards", "union", "contingent upon award",
]
#: List items that are spans of years, amounts or measures.
MEASURES = r"(?i)^\d{4}\s*[-–]\s*\d{4}$|\d+\s*[-–]\s*\d+\s*years?|^\d+\+\s*years?|\d+\s*years?.*experience|\d+\s*(?:lbs?|kg|meters?|feet?|hours?|days?)"

_FOUND = "array<struct<value: string, confidence: double, method: string>>"


def _entry(value: Column, method: str, confidence: float | None = None) -> Column:
    return F.struct(value.alias("value"), F.lit(CONFIDENCE[method] if confidence is None else confidence).alias("confidence"), F.lit(method).alias("method"))


def _with_method(values: Column, method: str, confidence: float | None = None) -> Column:
    return F.transform(values, lambda x: _entry(x, method, confidence))


def _values(entries: Column) -> Column:
    return F.transform(entries, lambda x: x["value"])


def _more(first: Column, second: Column, fold: Callable[[Column], Column] = lambda x: x) -> Column:
    """Entries of both; those of the second whose value the first has are left out."""

    def joined(both: Column) -> Column:
        have = F.transform(both["a"], lambda x: fold(x["value"]))
        return F.concat(both["a"], F.filter(both["b"], lambda x: ~F.array_contains(have, fold(x["value"]))))

    return lines.bound(F.struct(first.alias("a"), second.alias("b")), joined)


def _escaped(x: str) -> str:
    return "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in x)


def _hits(text: Column, low: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that are found."""
    return F.array_compact(F.array(*[F.when(needles.found(text, low, p), F.lit(n)) for n, p in sorted(patterns.items())]))


def _both(text: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use`` of a text, empty for null, and of it in lower case, each derived once."""
    return lines.bound(_text(text), lambda x: lines.bound(F.lower(x), lambda low: use(x, low)))


def _whole(phrases: list[str]) -> str:
    """A pattern of phrases as whole words, longer ones first; what can't begin one is passed over by its letter."""
    of: dict[str, list[str]] = {}
    for p in sorted(phrases, key=lambda p: (-len(p), p)):
        of.setdefault(p[0], []).append(_escaped(p[1:]))
    each = "|".join(_escaped(first) + "(?:" + "|".join(rest) + ")" for first, rest in of.items())
    return rf"(?U)(?=[{''.join(map(_escaped, of))}])(?<![\w-])(?:{each})(?![\w-])"


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def skills(text: Column) -> Column:
    """Skills as array<struct<value, confidence, method>>: phrases of the text's domain, then what patterns imply, then, where these
    are fewer than FEW, single words."""
    return _both(text, _skills).cast(_FOUND)


def _phrased(text: Column, low: Column, phrases: list[str]) -> Column:
    """Phrases as they stand in a text, as whole words; texts without any as mere letters aren't searched."""
    some = F.lit(False)
    for p in sorted({p.lower() for p in phrases}):
        some = some | low.contains(p)
    return F.when(some, F.regexp_extract_all(text, F.lit(_whole(phrases)), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _skills(text: Column, low: Column) -> Column:
    implied = _hits(text, low, {n: f"(?i)(?:{p})" for n, p in IMPLIED.items()})

    def by_domain(domain: Column) -> Column:
        exact = F.lit(None).cast("array<string>")
        for name, phrases in KEYPHRASES.items():
            exact = F.when(domain == name, _phrased(text, low, phrases)).otherwise(exact)
        bus = F.when(domain.isin("software", "defense") & needles.found(text, low, BUS), F.array(*map(F.lit, BUS_SKILLS))).otherwise(F.array().cast("array<string>"))
        return _more(_with_method(F.array_distinct(exact), "keyphrase_exact"), _with_method(F.array_distinct(F.concat(implied, bus)), "context_inferred"))

    single = F.array_distinct(F.transform(_phrased(text, low, KEYWORDS), lambda x: F.initcap(x)))
    found = lines.bound(lexicons.domain(text), by_domain)
    return lines.bound(found, lambda x: F.when(F.size(x) < FEW, _more(x, _with_method(single, "skill_keyword"))).otherwise(x))


def technologies(text: Column) -> Column:
    return _with_method(rules.named_technologies(_text(text)), "pattern_match").cast(_FOUND)


def _section(text: Column, low: Column, names: str, ends: str) -> Column:
    """What stands under a header, up to the next one or a word that ends it; empty if there is none."""
    found = F.regexp_extract(text, rf"(?is)(?:#{{2,3}}\s+)?(?:{names})[\s\n:]*(.+?)(?=\n#{{2,3}}|{ends}|---|\z)", 1)
    return F.when(needles.may(low, names), found).otherwise("")


def _items(section: Column, least: int = 10, most: int = 150) -> Column:
    """List items of a section of more than ``least`` and fewer than ``most`` characters."""
    found = F.transform(F.regexp_extract_all(section, F.lit(r"[*•\-]\s+(.+?)(?:\n|$)"), F.lit(1)), lambda x: F.btrim(x))
    return F.filter(found, lambda x: (F.length(x) > least) & (F.length(x) < most))


def _plain_years(x: Column) -> Column:
    return x.rlike(r"(?i)^\d+\+?\s+years\s+of\s+experience\s*$")


def _years(text: Column, words: str, joined: str = "", always: bool = False) -> Column:
    """Years of experience with what they are in; with ``always`` also those of nothing in particular."""
    pattern = rf"{YEARS}(?:\s+(?:{words})\s+([^.\n]+))?"
    found = F.when(text.contains("y") | text.contains("Y"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def said(x: Column) -> Column:
        return lines.bound(F.regexp_replace(F.btrim(F.regexp_extract(x, pattern, 2)), r"[.,;]+$", ""), lambda of: named(x, of))

    def named(x: Column, of: Column) -> Column:
        return F.when(of != "", F.concat(F.regexp_extract(x, pattern, 1), F.lit(f"+ years of experience {joined}"), of)).when(F.lit(always), F.concat(F.regexp_extract(x, pattern, 1), F.lit("+ years of experience")))

    return F.array_compact(F.transform(found, said))


def _stated(*conditions: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in conditions]))


def _preferred(items: Column) -> Column:
    return F.transform(items, lambda x: F.when(x.contains("(Preferred)"), x).otherwise(F.concat(x, F.lit(" (Preferred)"))))


def space_company(text: Column) -> Column:
    """Requirements of postings in structured bullets, as one maker of rockets writes them."""
    return _both(text, _space)


def _space(text: Column, low: Column) -> Column:
    items = F.filter(_items(_section(text, low, r"(?:minimum|required)\s+(?:qualifications?|experience)", "Preferred")), lambda x: ~_plain_years(x))
    stated = _stated((needles.found(text, low, r"(?i)background\s+check|security\s+clearance"), STANDARD_CHECK), (needles.found(text, low, r"(?i)U\.S\.\s+(?:citizen|national)"), CITIZEN))
    return F.array_distinct(F.concat(items, _years(text, r"in|with|focused\s+on", "in "), stated))


def aircraft_company(text: Column) -> Column:
    """Requirements of postings in prose and bullets, as one maker of aircraft writes them."""
    return _both(text, _aircraft)


def _aircraft(text: Column, low: Column) -> Column:
    items = F.filter(_items(_section(text, low, r"(?:basic|minimum|required)\s+(?:qualifications?|skills/experience)", "Preferred|Travel")), lambda x: ~_plain_years(x))
    stated = _stated((needles.found(text, low, BACHELOR), DEGREE), (needles.found(text, low, r"(?i)Top\s+Secret"), CLEARANCE), (needles.found(text, low, r"(?i)U\.S\.\s+Person|export\s+control"), PERSON), (needles.found(text, low, r"(?i)CodeVue|coding\s+challenge"), CODING), (needles.found(text, low, r"(?i)drug"), DRUG))
    wished = F.transform(_items(_section(text, low, r"(?:preferred|desired)\s+(?:qualifications?|experience)", "Travel|Background")), lambda x: F.concat(x, F.lit(" (Preferred)")))
    return F.array_distinct(F.concat(items, _years(text, r"in|with|using|focused\s+on"), stated, wished))


def any_company(text: Column) -> Column:
    """Requirements under the first header of basic or minimum qualifications, and a degree if none of them states one."""
    return _both(text, _any_company)


def _any_company(text: Column, low: Column) -> Column:
    parts = [_section(text, low, names, "Preferred") for names in (r"basic\s+qualifications", r"minimum\s+qualifications")]
    part = lines.bound(parts[0], lambda x: F.when(x != "", x).otherwise(parts[1]))
    listed = F.array_distinct(F.filter(_items(part), lambda x: ~_plain_years(x)))

    def with_degree(items: Column) -> Column:
        missing = needles.found(text, low, r"(?i)degree|bachelor|master") & ~F.exists(items, lambda x: F.lower(x).contains("degree"))
        return F.when(missing, F.array_append(items, F.lit("Bachelor's Degree or equivalent"))).otherwise(items)

    return lines.bound(listed, with_degree)


#: Requirements of a posting's text by the company that wrote it, lower case; others are read by ``any_company``.
PARSERS: dict[str, Callable[[Column], Column]] = {"blue origin": space_company, "boeing": aircraft_company}


def register_parser(company: str, parser: Callable[[Column], Column]) -> None:
    """Adds a company's way of writing requirements; a company has one only."""
    if company.lower().strip() in PARSERS:
        raise ValueError(f"company {company} has a parser already")
    PARSERS[company.lower().strip()] = parser


def company_requirements(text: Column, company: Column) -> Column:
    """Requirements by the parser of a row's company."""
    text, name = _text(text), F.lower(F.btrim(_text(company)))
    out = any_company(text)
    for known, parser in PARSERS.items():
        out = F.when(name == known, parser(text)).otherwise(out)
    return out


def stated_requirements(text: Column) -> Column:
    """Requirements by eight rules: years and items of the qualifications, wished ones, an advanced degree, citizenship, checks,
    a coding test, a bachelor's degree; each of the last is only added where none before states it."""
    return _both(text, _stated_requirements)


def _stated_requirements(text: Column, low: Column) -> Column:
    sections = [_section(text, low, names, "Preferred") for names in (r"basic\s+qualifications", r"minimum\s+qualifications", r"required\s+skills")]
    other = _section(text, low, r"required\s+skills/experience", "Preferred")
    wished = _preferred(_items(_section(text, low, r"(?:preferred|desired)\s+(?:qualifications?|experience)", "Background")))

    def listed(parts: Column) -> Column:
        years = F.concat(*[_years(parts[f"s{i}"], r"in|with|focused\s+on|involving|related\s+to|using", "", True) for i in range(3)])
        items = F.filter(F.concat(*[_items(parts[n]) for n in ("s0", "s1", "s3")]), lambda x: ~x.rlike(r"^\d+\+") & ~F.lower(x).contains("years of experience"))
        return F.array_distinct(F.concat(F.transform(years, lambda x: _normal_years(x)), items, wished))

    found = lines.bound(F.struct(*[s.alias(f"s{i}") for i, s in enumerate([*sections, other])]), listed)
    degree = r"(?i)(?:M\.S\.|MS|Master|PhD|Ph\.D\.)\s+(?:or|/)\s+(?:PhD|Ph\.D\.)"
    near = F.regexp_extract(text, rf"(?is)(.{{0,100}}{degree[4:]}.{{0,100}})", 1)
    advanced = F.when(needles.found(text, low, degree), F.when(F.lower(near).contains("preferred"), F.lit(f"{ADVANCED} (Preferred)")).otherwise(F.lit(ADVANCED)))
    found = F.concat(found, F.array_compact(F.array(advanced)))

    def unless(condition: Column, names: tuple[str, ...], value: str, low: bool) -> Callable[[Column], Column]:
        """An array with one more value if a condition holds and no value has one of some names."""

        def more(have: Column) -> Column:
            said = F.exists(have, lambda x: rules._any(F.lower(x) if low else x, names))
            return F.when(condition & ~said, F.array_append(have, F.lit(value))).otherwise(have)

        return more

    rest = [
        (needles.found(text, low, r"(?i)U\.S\.\s+(?:citizen|national)|permanent\s+resident"), ("U.S. citizen",), CITIZEN, False),
        (needles.found(text, low, r"(?i)background\s+check"), ("Background Check",), STANDARD_CHECK, False),
        (needles.found(text, low, r"(?i)drug"), ("drug",), DRUG, True),
        (needles.found(text, low, r"(?i)CodeVue|coding\s+challenge|technical.*assessment"), ("codevue", "coding"), CODING, True),
        (needles.found(text, low, BACHELOR), ("Bachelor", "Degree"), DEGREE, False),
    ]
    for rule in rest:
        found = lines.bound(found, unless(*rule))
    return F.array_distinct(found)


def _normal_years(x: Column) -> Column:
    head = F.regexp_extract(x, r"^(\d+\+ years of experience)", 1)
    low = F.lower(x)
    return F.when(low.contains("autonomy") & low.contains("aerospace"), F.concat(head, F.lit(" autonomy or aerospace autonomy/GNC"))).when(low.contains("autonomy"), F.concat(head, F.lit(" autonomy"))).otherwise(x)


def prose_requirements(text: Column) -> Column:
    """Sentences of 15 to 200 characters that state a requirement, without a last remark in brackets, end marks and runs of white space."""
    tidy = lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\s*\([^)]*\)\s*$", ""), r"[,;.!?]+$", ""), r"\s+", " ")
    stated = lambda s: (F.length(s) >= 15) & ~s.rlike(r"^[•*\-●]") & s.rlike("(?i)" + "|".join(rules.NARRATIVE))
    found = F.transform(F.filter(lines.sentences(_text(text)), stated), tidy)
    return F.array_distinct(F.filter(found, lambda s: (F.length(s) > 15) & (F.length(s) < 200)))


def requirements(text: Column, company: Column | None = None, narrative: bool = True) -> Column:
    """Requirements as array<struct<value, confidence, method>>: by the company's parser and from prose, or by rules where no company is given."""
    if company is None:
        return _with_method(stated_requirements(text), "fallback").cast(_FOUND)

    def own(x: Column) -> Column:
        return F.when(rules._any(F.lower(x), STRUCTURED) & (F.length(x) > 20), _entry(x, "structured_bullet")).otherwise(_entry(x, "pattern_match"))

    found = F.transform(company_requirements(text, company), own)
    if narrative:
        found = _more(found, _with_method(prose_requirements(text), "fallback", NARRATIVE_CONFIDENCE), F.lower)
    return found.cast(_FOUND)


#: Rewritings of a requirement before those of rules.PLAINER.
TRIMMED = [(r"(?i)\s+on\s+fast-paced\s+projects$", ""), (r"(?i)\s+on\s+military\s+installations?$", ""), (r"(?i),\s+(?:simulations|software),\s+and\s+[^,.]*$", ""), (r"(?i),\s+and\s+integrated\s+vehicle.*$", "")]


def normal_requirement(requirement: Column) -> Column:
    """A requirement in few words; a mark of preference stays at its end."""
    wished = requirement.contains("(Preferred)")
    out = F.btrim(F.replace(F.btrim(requirement), F.lit("(Preferred)"), F.lit("")))
    for pattern, by in TRIMMED:
        out = F.regexp_replace(out, pattern, by)

    def shorter(x: Column) -> Column:
        listed = x.rlike(r"(?i)^Experience\s+in\s+development,\s+implementation,\s+and")
        return F.when(listed, F.regexp_replace(F.regexp_replace(x, r"(?i)development,\s+", ""), r"(?i),\s+and\s+", " and ")).when(x.rlike(r"(?i)^Experience\s+in\s+development\s+and"), F.regexp_replace(x, r"(?i)development\s+and\s+", "")).otherwise(x)

    def without_brackets(pattern: str, by: str, kept: Column) -> Callable[[Column], Column]:
        return lambda x: F.when(kept | ~x.contains("("), x).otherwise(F.regexp_replace(x, pattern, by))

    def plainer(x: Column) -> Column:
        kept, y = x.contains("M.S. or Ph.D."), x
        for pattern, by in rules.PLAINER:
            y = lines.bound(y, without_brackets(pattern, by, kept)) if "\\(" in pattern else F.regexp_replace(y, pattern, by)
        return y

    def named(x: Column) -> Column:
        return F.when(F.lower(x) == "experience in development", "").otherwise(F.regexp_replace(x, r"\s*\(HIL\)", ""))

    # each step is bound, so that no step repeats those before it
    for step in (shorter, plainer, named):
        out = lines.bound(out, step)
    return F.btrim(lines.bound(out, lambda x: F.when(wished & (x != ""), F.concat(x, F.lit(" (Preferred)"))).otherwise(x)))


def normal_skill(skill: Column) -> Column:
    """A skill as its phrase is written, others with capitals."""
    known = sorted({p for ps in KEYPHRASES.values() for p in ps} | set(IMPLIED))
    return F.when(skill.isin(*known), skill).otherwise(F.initcap(skill))


def _scored(values: Column, entries: Column) -> Column:
    """Sorted values with the mean confidence of the entries that hold them or are held by them, 0.5 where there is none."""

    def confidence(low: Column, known: Column) -> Column:
        near = F.transform(F.filter(known, lambda e: e["low"].contains(low) | low.contains(e["low"])), lambda e: e["confidence"])
        mean = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / F.size(x)
        return lines.bound(near, lambda x: F.round(F.when(F.size(x) > 0, mean(x)).otherwise(0.5), 2))

    def scored(both: Column) -> Column:
        return F.transform(both["values"], lambda v: F.struct(v.alias("value"), lines.bound(F.lower(v), lambda low: confidence(low, both["known"])).alias("confidence")))

    known = F.transform(entries, lambda e: F.struct(F.lower(e["value"]).alias("low"), e["confidence"].alias("confidence")))
    # a function's argument, not its body: values may come from Python
    return lines.bound(F.struct(F.array_sort(F.array_distinct(values)).alias("values"), known.alias("known")), scored)


def mean_confidence(found: Column) -> Column:
    """Mean confidence of an array of structs, 0 where it is empty."""
    total = F.aggregate(found, F.lit(0.0), lambda a, x: a + x["confidence"])
    return F.when(F.size(found) > 0, F.round(total / F.size(found), 2)).otherwise(0.0)


def with_entities(df: DataFrame, text: str, company: str | None = None) -> DataFrame:
    """``df`` with skills, technologies and requirements (array<struct<value, confidence>>), domain, and the mean confidence of each;
    columns of these names are replaced."""
    names = ("skills", "technologies", "requirements")
    body = F.col(text)
    made = {"_skills": skills(body), "_technologies": technologies(body), "_requirements": requirements(body, F.col(company) if company else None)}
    out = df.select(F.struct(*[c for c in df.columns if c not in (*names, "domain", *[f"avg_{n}_confidence" for n in names])]).alias("_row"), lexicons.domain(_text(body)).alias("domain"), F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))).alias("_made"))
    out = out.select("_row", "domain", "_made.*")
    plain = F.filter(F.transform(_values(F.col("_requirements")), normal_requirement), lambda x: x != "")
    out = lines.once(out, "_plain", plain).withColumn("_distinct", similarity.fuzzy_distinct(F.col("_plain")))
    scored = {"skills": _scored(F.transform(_values(F.col("_skills")), normal_skill), F.col("_skills")), "technologies": _scored(_values(F.col("_technologies")), F.col("_technologies")), "requirements": _scored(F.col("_distinct"), F.col("_requirements"))}
    out = out.withColumns(scored)
    return out.select("_row.*", *names, "domain", *[mean_confidence(F.col(n)).alias(f"avg_{n}_confidence") for n in names])


def routed(md: Column) -> Column:
    """Struct of skills, technologies and requirements of Markdown, by the header that list items and words stand under.

    Items go to the skills under headers of skills, to the requirements under those of requirements; technologies are taken
    from words under headers of skills, duties and descriptions. Sections of pay, culture and the like are passed over.
    """
    tech = lexicons.terms(lexicons.TECHNOLOGY)
    skilled = lambda k: rules._any(k, SKILL_SECTIONS)
    asked = lambda k: rules._any(k, REQUIREMENT_SECTIONS) & ~skilled(k)
    worded = lambda k: skilled(k) | rules._any(k, DESCRIPTION_SECTIONS) | (k == "responsibilities")

    def items(s: Column) -> Column:
        found = F.transform(F.regexp_extract_all(s["value"], F.lit(r"(?m)^(?:[*\-+]|\d+\.)\s+(.+)$"), F.lit(1)), lambda x: F.btrim(x))
        return F.filter(found, lambda x: (F.length(x) > 3) & ~x.rlike(MEASURES) & (F.size(F.split(x, ",")) < 3))

    def kept(s: Column) -> Column:
        skipped = lines.bound(F.replace(s["key"], F.lit("_"), F.lit(" ")), lambda k: rules._any(k, SKIPPED_SECTIONS))
        return ~skipped & (F.btrim(s["value"]) != "")

    def parted(sections: Column) -> Column:
        def of(keep: Callable[[Column], Column], take: Callable[[Column], Column]) -> Column:
            return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(sections, lambda s: keep(s["key"])), take))))

        return F.struct(
            of(skilled, items).alias("skills"),
            of(worded, lambda s: F.filter(lexicons.found_words(s["value"], tech), lambda w: F.length(w) > 2)).alias("technologies"),
            of(asked, items).alias("requirements"),
        )

    # sections are bound, so that a text is cut into them once for all three
    return lines.bound(F.filter(rules.section_entries(md), kept), parted)
