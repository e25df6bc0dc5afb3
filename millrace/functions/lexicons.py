"""Word lists of postings, as tables and predicates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import needles
from millrace.functions import text as lines

#: Technologies by category.
TECHNOLOGY = {
    "languages": "python javascript typescript java c# csharp go rust php ruby c++ scala kotlin".split(),
    "web": "react vue angular node express django flask fastapi next nextjs nuxt svelte astro".split(),
    "infrastructure": "aws gcp azure docker kubernetes k8s terraform helm ansible consul vault prometheus docker-compose podman buildah argocd flux gitops harbor quay".split(),
    "databases": "postgresql mysql mongodb redis cassandra elasticsearch kafka dynamodb firestore snowflake bigquery duckdb cockroachdb timescaledb clickhouse dvc".split(),
    "hardware": "verilog systemverilog asic fpga arm rtl dft lint ddr spi i2c uart can esd lef def gds matlab ansys nastran optistruct creo solidworks catia windchill simulink comsol fft ifft cordic mac".split(),
    "ml_ai": "tensorflow pytorch sklearn jax huggingface transformers onnx keras xgboost lightgbm catboost mlflow wandb opencv yolo spacy bert gpt llm timm".split(),
    "tools": "jira confluence git gitlab github bitbucket circleci travis jenkins airflow prefect rest grpc graphql sql pydantic sqlalchemy celery mqtt amqp websocket coap cam cnc plm erp mrp".split(),
    "methodologies": "agile scrum kanban tdd bdd ddd lean xp".split(),
    "robotics": "ros ros2 gazebo moveit webots".split(),
    "other": "protobuf json xml yaml kubeflow ray cadence synopsys".split(),
}
#: Soft skills by category.
SOFT_SKILLS = {
    "communication": ["communication", "written communication", "oral communication", "presentation", "public speaking", "writing", "writing skills", "speaking", "verbal", "articulate"],
    "leadership": ["leadership", "project management", "team leadership", "management", "leading", "directing", "supervising", "mentoring", "coaching", "training"],
    "teamwork": ["teamwork", "collaboration", "team collaboration", "cooperative", "interpersonal", "interpersonal skills", "working with others", "cooperation", "collaborative"],
    "problem_solving": ["problem-solving", "problem solving", "critical thinking", "analytical", "analytical skills", "analytical thinking", "analysis", "reasoning", "logical thinking", "troubleshooting"],
    "organization": ["organizational", "organizational skills", "time management", "planning", "organization", "scheduling", "multitasking", "prioritization"],
    "emotional_intelligence": ["emotional intelligence", "empathy", "self-awareness", "self-regulation", "relationship management", "motivation", "adaptability", "resilience"],
    "adaptability": ["adaptability", "flexibility", "learning ability", "quick learner", "continuous learning", "learning agility", "innovative", "creative"],
    "customer_relations": ["customer service", "customer focus", "client relations", "negotiation", "persuasion", "conflict resolution", "listening"],
}
#: Signals of each domain, in the order in which ties are settled.
DOMAINS = {
    "aerospace": [r"\baerospace\b", r"\bflight\s+(?:operations|vehicle|dynamics)", r"\bGNC\b|guidance\s+(?:and\s+)?control", r"\bAUV\b|autonomous\s+vehicle", r"\b(?:launch|takeoff|climb|descent)\b", r"\baircraft\s+(?:performance|dynamics)", r"\btelemetry\s+(?:processing|system)", r"\bATOP\b|optimal\s+performance"],
    "software": [r"\bdistributed\s+(?:system|software)", r"\bcloud\s+(?:service|infrastructure|deployment)", r"\bDevOps\b|CI/CD|microservices", r"\b(?:API|REST|GraphQL|OpenAPI)\b", r"\bscalable.*system\b|system.*scalable", r"\bsensor\s+data\b|data\s+(?:transformation|analytics|pipeline)", r"\b(?:ARINC|binary\s+data|telemetry)\b"],
    "defense": [r"\b(?:Defense|DoD|military)\b", r"\bclassified\b|Top\s+Secret|Secret\s+Clearance", r"\bRocky\s+program\b|weapons\s+system", r"\bclosed\s+area\s+development", r"\bGFE\b|government\s+furnished"],
    "hardware": [r"\bASIC\b|FPGA\b|circuit\b", r"\bVerilog\b|SystemVerilog\b", r"\bHDL\b|hardware\s+design", r"\bsynthesis\b|place\s+and\s+route", r"\bDFT\b|formal\s+verification"],
}


def table(spark: SparkSession, **lexicons: dict[str, list[str]]) -> DataFrame:
    """(lexicon, category, term)."""
    rows = [(name, category, term) for name, lexicon in lexicons.items() for category, terms in lexicon.items() for term in terms]
    return spark.createDataFrame(rows, "lexicon string, category string, term string")


def counts(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("lexicon", "category").agg(F.count("*").alias("n"))


def terms(lexicon: dict[str, list[str]]) -> list[str]:
    return sorted({t for ts in lexicon.values() for t in ts})


def word_array(text: Column) -> Column:
    """Lower-case words, with the marks that names of technologies have inside."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}+#.-]*[\p{L}\p{N}+#]|[\p{L}\p{N}]"), 0)


def found_words(text: Column, words: Iterable[str]) -> Column:
    """Sorted words of a list that a text has."""
    return F.array_sort(F.array_intersect(F.array_distinct(word_array(text)), F.array(*map(F.lit, sorted(set(words))))))


def found_phrases(text: Column, phrases: Iterable[str]) -> Column:
    """Sorted phrases of a list that stand in a text between word boundaries."""
    low = F.lower(F.coalesce(text, F.lit("")))
    quoted = [(p, r"(?U)(?<![\w-])" + "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in p) + r"(?![\w-])") for p in sorted(set(phrases))]
    return lines.bound(low, lambda x: F.array_compact(F.array(*[F.when(x.contains(p) & x.rlike(q), F.lit(p)) for p, q in quoted])))


def domain(text: Column) -> Column:
    """Domain with the most signals in a text; the first of equals, general for none."""

    # every pattern is searched once: the best is the largest of a row's (score, place, name)
    def best(low: Column) -> Column:
        scored = [F.struct(sum((needles.found(low, low, f"(?i){p}").cast("int") for p in patterns), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, patterns) in enumerate(DOMAINS.items())]
        return lines.bound(F.array_max(F.array(*scored)), lambda x: F.when(x["n"] > 0, x["name"]).otherwise("general"))

    return lines.bound(F.lower(F.coalesce(text, F.lit(""))), best)


def case_flips(text: Column) -> Column:
    """Changes between lower and upper case inside a text."""
    return F.size(F.filter(F.split(text, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Ll})"), lambda x: x != "")) - 1


def is_fragment(entity: Column, lexicon: Iterable[str] = ()) -> Column:
    """Whether an entity is a broken piece: many case flips, unpaired brackets, tags or references, a conjunction among four words or more."""
    opened = F.regexp_count(entity, F.lit(r"[(\[{]")) != F.regexp_count(entity, F.lit(r"[)\]}]"))
    flips = (case_flips(entity) >= 3) & ~F.lower(entity).isin(*(list(lexicon) or [""]))
    return flips | opened | entity.rlike(r"<[^>]*>|&\w+;") | ((F.size(F.split(F.btrim(entity), r"\s+")) >= 4) & entity.rlike(r"(?i)\s(?:and|or|but)\s"))


def is_noise(entity: Column) -> Column:
    """Whether an entity is a number, a share, an amount, an article with a word, or of a length that says nothing."""
    bare = F.btrim(entity)
    return (F.length(bare) < 2) | (F.length(bare) > 70) | bare.rlike(r"^[\d\s.,%+-]+$") | bare.contains("$") | bare.rlike(r"(?i)^(?:the|a|an)\s")


def entities(candidates: Column, lexicon: Iterable[str] = ()) -> Column:
    """Sorted unique entities of an array without fragments and noise."""
    return F.array_sort(F.array_distinct(F.filter(candidates, lambda x: ~is_fragment(x, lexicon) & ~is_noise(x))))


def facts(text: Column) -> Column:
    """Struct of years, degrees and citizenship phrases found in a text."""
    find = lambda p: F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), 0))
    return F.struct(find(r"\d+\+?\s*(?:years|yrs)").alias("years"), find(r"(?:Bachelor|Master|PhD|BS|MS|BA|MA)(?:'s)?(?:\s+degree)?").alias("degrees"), find(r"(?:U\.?S\.?\s+)?[Cc]itizen(?:ship)?").alias("citizen"))
