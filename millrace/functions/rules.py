"""Rules over words, sections and sentences of postings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import needles
from millrace.functions import text as lines

#: Words without content, by category.
NOISE = {
    "articles_determiners": "the a an this that these those my your his her its our their some".split(),
    "prepositions": "in on at of with by to from for about during before after above below under over between among through".split(),
    "conjunctions": "and or but nor yet so as if because although while since".split(),
    "pronouns": "i you he she it we they me him what which who".split(),
    "generic_verbs": "do make have be get go come know take see think say give keep try".split(),
    "numbers_measurements": "one two three four five six seven eight nine ten percent years months weeks days hours plus minus".split(),
    "generic_nouns": "thing stuff way work life area part type sort kind form case point item number level range value".split(),
    "filler_words": "really very just only also even still yet already quite rather somewhat somehow perhaps maybe actually basically".split(),
}
#: Names of employers, by category.
EMPLOYERS = {
    "aerospace_defense": ["boeing", "lockheed", "lockheed martin", "raytheon", "northrop", "northrop grumman", "general dynamics"],
    "technology": ["apple", "google", "microsoft", "meta", "amazon", "tesla", "intel", "nvidia", "ibm"],
    "space_tech": ["spacex", "blue origin"],
    "universities": ["uw", "mit", "stanford", "berkeley", "cmu", "caltech", "princeton", "yale"],
    "robotics_manufacturing": ["carbon", "universal", "abb", "kuka", "boston dynamics", "isac"],
    "staffing_agencies": ["heidrick", "recruiter", "staffing", "talent", "agency"],
    "consulting": ["consulting", "accenture", "deloitte", "pwc"],
    "government": ["government", "federal", "department of"],
    "financial_services": ["goldman", "jpmorgan", "bank of america"],
}
#: Compounds that name a technology, and words that make one of a phrase of two words or more.
COMPOUNDS = [
    "software development", "software engineering", "software development engineer", "software development platform", "software development lifecycle", "software development practices", "software development methodology",
    "data processing", "data processing pipeline", "data processing system", "data processing infrastructure", "big data processing", "data processing workflow", "etl pipeline", "data pipeline",
    "engineering technology", "engineering technology platform", "engineering technology stack", "engineering technology framework", "engineering technology solution", "engineering technology system",
    "manufacturing engineering", "manufacturing engineering process", "manufacturing engineering technology", "manufacturing engineering automation", "manufacturing engineering design", "manufacturing engineering system",
    "system-level", "system-level design", "system-level architecture", "system-level integration", "system-level requirements", "system-level planning", "system-level optimization",
    "spring framework", "spring boot", "react native", "express.js", "web framework", "api framework", "testing framework", "javascript framework", "python framework",
    "web service", "microservice", "microservices", "cloud service", "aws service", "api service", "rest service", "soap service",
    "sql database", "nosql database", "relational database", "distributed database", "time series database", "python django", "python flask", "javascript react", "node.js", "python pandas", "python numpy",
    "cloud infrastructure", "infrastructure as code", "container orchestration", "kubernetes cluster", "docker container", "ci/cd pipeline", "microservices architecture", "event-driven architecture", "distributed system", "scalable system", "high availability",
]
COMPOUND_WORDS = ["framework", "library", "database", "service", "platform", "application", "system", "tool", "utility", "plugin", "extension", "architecture", "infrastructure", "pipeline", "workflow", "process"]
COMPOUND_STARTS = ["software", "data processing", "engineering technology", "manufacturing", "system-level", "system"]
#: Patterns of named technologies.
TECHNOLOGIES = {
    "Java": [r"\bJava\b(?!\s*Script)"], "C++": [r"\bC\+\+"], "C": [r"\bC\b(?!\+|#)"], "C#": [r"\bC#"], "Python": [r"\bPython\b"], "JavaScript": [r"\bJavaScript\b", r"\bJS\b"], "TypeScript": [r"\bTypeScript\b"],
    "Go": [r"\bGo\b(?!\s+(?:language|programming))"], "Rust": [r"\bRust\b"], "Verilog": [r"\bVerilog\b"], "SystemVerilog": [r"\bSystemVerilog\b", r"System\s+Verilog"],
    "Apache Parquet": [r"Apache\s+Parquet", r"\bParquet\b"], "Apache ORC": [r"Apache\s+ORC", r"\bORC\b(?!\s+orchestra)"], "HDF5": [r"\bHDF5\b", r"\bHDF\s+5\b"], "Delta Lake": [r"Delta\s+Lake"],
    "Apache Spark": [r"Apache\s+Spark", r"\bSpark\b"], "Hadoop": [r"\bHadoop\b"], "Elasticsearch": [r"\bElasticsearch\b"], "PostgreSQL": [r"\bPostgreSQL\b", r"\bPostgres\b"], "MongoDB": [r"\bMongoDB\b"], "MySQL": [r"\bMySQL\b"],
    "Oracle": [r"\bOracle\s+Database\b", r"\bOracle\b(?!\s+Corporation)"], "Spring Framework": [r"Spring\s+Framework", r"\bSpring\b(?!\s+Boot)"], "Spring Boot": [r"Spring\s+Boot"], "React": [r"\bReact\b", r"\bReactJS\b"], "Angular": [r"\bAngular\b"],
    "Vue": [r"\bVue\.js\b", r"\bVue\b"], "Hibernate": [r"\bHibernate\b"], "ARINC 429": [r"ARINC\s+429"], "ARINC 717": [r"ARINC\s+717"], "ARINC 767": [r"ARINC\s+767"], "AWS": [r"\bAWS\b", r"\bAmazon\s+Web\s+Services\b"], "Azure": [r"\bAzure\b"],
    "Kubernetes": [r"\bKubernetes\b", r"\bK8s\b"], "Docker": [r"\bDocker\b"], "Jenkins": [r"\bJenkins\b"], "Git": [r"\bGit\b"], "Maven": [r"\bMaven\b"], "Gradle": [r"\bGradle\b"], "REST": [r"\bREST\b", r"\bRESTful\b"], "GraphQL": [r"\bGraphQL\b"],
    "OpenAPI": [r"\bOpenAPI\b"], "SOAP": [r"\bSOAP\b"], "AI": [r"\bAI\b", r"\bartificial\s+intelligence\b"], "MATLAB": [r"\bMATLAB\b"],
    "Simulink": [r"\bSimulink\b"], "AI-assisted coding techniques": [r"AI-assisted\s+coding", r"AI\s+coding\s+techniques"], "DOORS Next Generation": [r"DOORS\s+Next\s+Generation", r"DOORS\s+NG"], "JIRA": [r"\bJIRA\b"], "ARM": [r"\bARM\b"],
}
#: Where an employer's name is looked for, in this order.
EMPLOYER_PATTERNS = [
    r"(?im)^#\s+([^\n]+)", r"(?im)^##\s+company\b.*?\n([^\n]+)", r"(?im)company:\s*([^\n]+)", r"(?im)employer:\s*([^\n]+)",
    r"(?im)\b([A-Z][a-zA-Z0-9\s&]*(?:Robotics|Corp|Inc|Ltd|LLC|Technology|AI|Systems|Software|Services))\b", r"(?im)\b([A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)?)\s+(?:is the|is a|has|announces)",
]
#: Headers that open a posting's requirements, and texts that end them.
OPENERS = [
    r"(?i)(?:qualifications|requirements|what we're looking for|what we need|what you'll need|must-have|essential|desired qualifications)(?:\s*[:|\n])",
    r"(?i)(?:responsibilities|what you'll do|your role|what you will|primary responsibilities)(?:\s*[:|\n])",
    r"(?i)(?:skills|technical skills|core skills|desired skills)(?:\s*[:|\n])",
]
ENDERS = ["equal opportunity", "affirmative action", "background check", "export control", "compliance", "how to apply", "apply now", "benefits", "compensation"]
#: Patterns of salaries, places and legal remarks up to the end of their line.
REMARKS = [r"(?is)salary.*?(?:\n|\z)", r"(?is)\$[\d,]+.*?(?:year|hour|annually)", r"(?is)(?:remote|on-site|location).*?(?:\n|\z)", r"(?is)(?:equal opportunity|affirmative action|fcra|dbids).*?(?:\n|\z)", r"(?is)(?:background check|export control).*?(?:\n|\z)", r"(?is)(?:benefits|compensation|401\(k\)|health insurance).*?(?:\n|\z)"]
#: Marks of Markdown.
MARKDOWN = r"(?m)^#+\s+|^[*\-+]\s+|^\d+\.\s+|\*\*.*?\*\*|__.*?__|`.*?`"
#: Section names and words of their headers, in order; phrases of lines that aren't part of a section.
SECTION_WORDS = [("qualifications", ("qualif", "requirement", "essential")), ("skills", ("skill", "technical", "core")), ("knowledge", ("knowledge", "experience")), ("responsibilities", ("respons", "duty", "what you"))]
STRAY_PHRASES = ["offers additional compensation", "base pay", "pay ranges", "pay equity", "individual base", "pre-ipo stock", "target earning", "commissions", "offers compensation", "benefits premiums", "on target earning"]
#: Clauses of sentences that state a requirement, and what is taken from them.
NARRATIVE = [r"experience\s+(?:with|in|using|involving|developing|designing)", r"ability\s+to\s+(?:work|develop|design|manage|lead|test|implement)", r"(?:demonstrated|proven)\s+(?:experience|ability|knowledge|expertise)", r"(?:knowledge|expertise)\s+(?:of|in|with)", r"(?:familiarity|proficiency)\s+(?:with|in)", r"(?:strong|deep)\s+(?:experience|knowledge|background)", r"experience\s+(?:leading|managing|working)", r"(?:degree|certification|credential)\s+(?:in|from)", r"(?:must|should|required\s+to)\s+(?:have|be|know)", r"(?:ability|willingness)\s+to\s+"]
FIELDS = {
    "experience": [r"(?i)experience\s+(?:with|in|using)\s+([^,.;]+?)(?:\s+and|\s+or|,|\.|\s+for)", r"(?i)expertise\s+(?:in|with)\s+([^,.;]+?)(?:\s+and|\s+or|,|\.|\s+for)", r"(?i)(?:strong|deep)\s+(?:knowledge|background)\s+(?:in|with)\s+([^,.;]+?)(?:\s+and|\s+or|,|\.|\s+for)", r"(?i)proficiency\s+(?:with|in)\s+([^,.;]+?)(?:\s+and|\s+or|,|\.|\s+for)"],
    "education": [r"(?i)(?:B\.?S\.?|Bachelor['s]*)\s+(?:Degree|of\s+Science)\s+(?:in|from)\s+([^,.;]+)", r"(?i)(?:M\.?S\.?|Master['s]*)\s+(?:Degree|of\s+Science)\s+(?:in|from)\s+([^,.;]+)", r"(?i)(?:Ph\.?D\.?|PhD)\s+(?:in|from|of)\s+([^,.;]+)", r"(?i)(?:Certification|Certified)\s+(?:in|from|by)\s+([^,.;]+)"],
    "leadership": [r"(?i)(?:led|managed|directed|supervised)\s+([^,.;]+?)(?:\s+(?:team|group|department)|,|\.)", r"(?i)(?:developed|designed|implemented|built)\s+([^,.;]+?)(?:\s+system|s|,|\.)", r"(?i)(?:oversaw|owned|drove)\s+([^,.;]+?)(?:\s+project|s|,|\.)"],
}
#: Rewritings of a requirement, in this order.
PLAINER = [(r"(?i)\s+with\s+the\s+development\s+of\s+", " with "), (r"(?i)^Demonstrated\s+experience\s+(?:in|with|involving)\s+", "Experience in "), (r"(?i)^Demonstrated\s+ability\s+to\s+", "Ability to "), (r"(?i)\s+as\s+well\s+as\s+", " and "), (r"\s+,\s+", ", "), (r"\s*\(\s*e\.g\..*?\)\s*", " "), (r"\s*\([^)]*\)\s*$", ""), (r"\s+", " ")]


def is_noise_word(word: Column) -> Column:
    return F.lower(F.btrim(word)).isin(*sorted({w for ws in NOISE.values() for w in ws}))


def is_employer(name: Column, whole: bool = True) -> Column:
    """Whether a text is the name of an employer, or holds one."""
    names = sorted({n for ns in EMPLOYERS.values() for n in ns})
    low = F.lower(F.btrim(name))
    return low.isin(*names) if whole else _any(low, names)


def _any(x: Column, parts: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | x.contains(p)
    return out


def compound_score(phrase: Column) -> Column:
    """0.95 for a known compound, 0.7 and 0.55 for phrases of words that make one, else 0."""
    low = F.lower(F.btrim(phrase))
    many = F.size(F.split(low, r"\s+")) >= 2
    return F.when(F.length(low) < 3, 0.0).when(low.isin(*COMPOUNDS), 0.95).when(many & _any(low, COMPOUND_WORDS), 0.70).when(many & _any(low, COMPOUND_STARTS), 0.55).otherwise(0.0)


def named_technologies(text: Column) -> Column:
    """Sorted names of technologies of which a pattern is found."""

    def named(low: Column) -> Column:
        found = []
        for name, patterns in sorted(TECHNOLOGIES.items()):
            hit = F.lit(False)
            for p in patterns:
                hit = hit | needles.found(text, low, f"(?i){p}")
            found.append(F.when(hit, F.lit(name)))
        return F.array_compact(F.array(*found))

    return lines.bound(F.lower(text), named)


def employer(md: Column) -> Column:
    """First name of more than one character that the patterns find; null for none."""
    found = [F.btrim(F.regexp_extract(md, p, 1)) for p in EMPLOYER_PATTERNS]
    return F.coalesce(*[F.when(F.length(x) > 1, x) for x in found])


def requirements_part(text: Column) -> Column:
    """What stands between the first opening header and the first ender after it; empty without a header."""
    found = F.array_compact(F.array(*[F.when(text.rlike(p), F.struct(F.regexp_instr(text, F.lit(p)).alias("at"), F.length(F.regexp_extract(text, p, 0)).alias("n"))) for p in OPENERS]))

    def cut(first: Column) -> Column:
        rest = F.substr(text, first["at"] + first["n"])
        stops = F.array_compact(F.array(*[F.nullif(F.instr(F.lower(rest), e), F.lit(0)) for e in ENDERS]))
        return F.when(F.size(stops) > 0, F.substr(rest, F.lit(1), F.array_min(stops) - 1)).otherwise(rest)

    bound = F.transform(F.filter(F.array(F.array_min(found)), lambda x: x.isNotNull()), cut)
    return F.coalesce(F.get(bound, F.lit(0)), F.lit(""))


def without_remarks(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for p in REMARKS:
        out = F.regexp_replace(out, p, "")
    return out


def is_markdown(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(MARKDOWN)


def section_name(header: Column) -> Column:
    """Canonical section of a header; an unknown one with underscores."""
    def named(low: Column) -> Column:
        out = F.when(F.lit(False), "")
        for name, words in SECTION_WORDS:
            out = out.when(_any(low, words), name)
        return out.otherwise(F.replace(low, F.lit(" "), F.lit("_")))

    return lines.bound(F.lower(header), named)


def section_entries(md: Column) -> Column:
    """Array of (key, value): canonical sections with their texts; a later section of a name takes the place of an earlier one, text before the first header has none."""
    parts = F.filter(lines.sections(md), lambda x: x.rlike(r"^(?:#{1,3}\s|\*\*)"))
    head = lambda x: F.btrim(F.regexp_replace(F.substring_index(x, "\n", 1), r"^#+\s*|\*\*|:\s*$", ""))
    body = lambda x: F.btrim(F.regexp_replace(F.when(F.instr(x, "\n") > 0, F.substr(x, F.instr(x, "\n") + 1)).otherwise(""), r"(?m)^---\s*$", ""), F.lit(" \n"))
    entries = F.transform(parts, lambda x: F.struct(section_name(head(x)).alias("key"), lines.without_phrases(body(x), STRAY_PHRASES).alias("value")))

    # of equal keys the last one stays: the first in reverse
    def once(both: Column) -> Column:
        return F.filter(both["turned"], lambda x, i: F.array_position(both["keys"], x["key"]) == i + 1)

    with_keys = lines.bound(F.reverse(entries), lambda t: F.struct(t.alias("turned"), F.transform(t, lambda y: y["key"]).alias("keys")))
    return F.reverse(lines.bound(with_keys, once))


def section_map(md: Column) -> Column:
    """Map of canonical sections to their texts, as ``section_entries`` has them."""
    return F.map_from_entries(section_entries(md))


def narrative(text: Column) -> Column:
    """Sentences of 15 to 200 characters that state a requirement and aren't list items."""
    found = lambda s: (F.length(s) >= 15) & (F.length(s) < 200) & ~s.rlike(r"^[•*\-●]") & s.rlike("(?i)" + "|".join(NARRATIVE))
    return F.array_sort(F.array_distinct(F.filter(lines.sentences(text), found)))


def fields(text: Column, kind: str) -> Column:
    """What the patterns of a kind (experience, education, leadership) take from a text, of 3 to 100 characters."""
    found = F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), 1) for p in FIELDS[kind]])
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: F.btrim(x)), lambda x: F.length(x).between(3, 100))))


def plainer(requirement: Column) -> Column:
    out = requirement
    for pattern, by in PLAINER:
        out = F.regexp_replace(out, pattern, by)
    return F.btrim(out)


def bullet_texts(text: Column) -> Column:
    """Distinct texts of list items longer than five characters."""
    found = F.transform(F.filter(lines.lines(text), lambda x: x.rlike(r"^\s*[•*●-]\s+")), lambda x: F.btrim(F.regexp_replace(x, r"^\s*[•*●-]\s+|\s*[\d•*-]+$", "")))
    return F.array_distinct(F.filter(found, lambda x: F.length(x) > 5))


def kept_words(text: Column, keep: Iterable[str] = ("not", "no", "with", "without", "and", "or")) -> Column:
    """Words of a text without noise words, but for some."""
    drop = sorted({w for ws in NOISE.values() for w in ws} - set(keep))
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}'+#.-]*"), 0), lambda w: ~w.isin(*drop))
