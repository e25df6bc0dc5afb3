"""Full-text search: an index of postings, and queries of terms, phrases, prefixes, AND, OR, NOT and parentheses.

Terms are folded (lower case, no diacritics) and cut at anything but letters and digits. A malformed or empty query finds
nothing.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LETTERS = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿœæß"
_PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyoas"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), _LETTERS, _PLAIN), F.lit(r"[\p{L}\p{N}]+"), 0)


def folded(word: str) -> str:
    low = word.lower().translate(str.maketrans(_LETTERS, _PLAIN))
    return "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c))


def index(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(token, key, field, pos) of every word of some columns."""
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("body")) for c in columns])).alias("f")
    return df.select(key, fields).select(key, "f.field", F.posexplode(tokens(F.col("f.body"))).alias("pos", "token"))


#: Parts that a stored index is split in by token; a query reads only those of its words.
PARTS = 256


def _part(token: Column) -> Column:
    return F.pmod(F.crc32(token.cast("binary")), F.lit(PARTS)).cast("int")


def write_index(df: DataFrame, key: str, columns: list[str], path: str, tasks: int = 0) -> None:
    """Stores the index of some columns, in parts by token and sorted by it within, so that lookups read little of it.

    ``tasks`` is how many tasks write it, for large tables: what each sorts is then bounded however many rows there are.
    """
    rows = index(df, key, columns).withColumn("part", _part(F.col("token")))
    # a frequent word's postings are dealt by key as well, to more tasks the more there are, so that no task writes all of them
    deal = ["part", F.pmod(F.xxhash64(key), F.lit(max(8, tasks // 8)))]
    held = rows.repartition(tasks, *deal) if tasks else rows.repartition(*deal)
    held.sortWithinPartitions("part", "token").write.mode("overwrite").partitionBy("part").parquet(path)


def read_index(spark: SparkSession, path: str, query: str) -> DataFrame:
    """What a stored index has of a query's words; of a query with prefixes all of it."""
    tree, whole = parsed(query), spark.read.parquet(path)
    words: list[str] = []
    todo = [tree] if tree else []
    while todo:
        node = todo.pop()
        if node.kind == "prefix":
            return whole
        if node.kind in ("term", "phrase"):
            words += node.parts
        else:
            todo += node.parts
    parts = sorted({zlib.crc32(w.encode()) % PARTS for w in words})
    return whole.filter(F.col("part").isin(parts) & F.col("token").isin(words)).drop("part")


def lookup(df: DataFrame, path: str, query: str, key: str = "job_id", low: float = 0, high: float = 100, limit: int = 20) -> DataFrame:
    """As ``keyword``, through a stored index."""
    out = indexed(df, read_index(df.sparkSession, path, query), query, key).filter(F.col("overall_score").between(low, high))
    return out.orderBy(F.desc("overall_score"), key).limit(limit)


@dataclass
class Node:
    kind: str
    parts: list


def parsed(query: str) -> Node | None:
    """Tree of a query; None if it is malformed or empty."""
    items = re.findall(r'"[^"]*"|\(|\)|[^\s()"]+', query)
    if not items or query.count('"') % 2:
        return None
    at = 0

    def either() -> Node | None:
        nonlocal at
        parts = [both()]
        while at < len(items) and items[at] == "OR":
            at += 1
            parts.append(both())
        return None if None in parts else parts[0] if len(parts) == 1 else Node("or", parts)

    def both() -> Node | None:
        nonlocal at
        out = one()
        while out is not None and at < len(items) and items[at] not in ("OR", ")"):
            kind = "and"
            if items[at] in ("AND", "NOT"):
                kind = "not" if items[at] == "NOT" else "and"
                at += 1
            other = one()
            if other is None:
                return None
            out = Node(kind, [out, other])
        return out

    def one() -> Node | None:
        nonlocal at
        if at >= len(items) or items[at] in ("AND", "OR", "NOT", ")"):
            return None
        item = items[at]
        at += 1
        if item == "(":
            inner = either()
            if at >= len(items) or items[at] != ")":
                return None
            at += 1
            return inner
        if item.startswith('"'):
            words = re.findall(r"\w+", folded(item))
            return Node("phrase", words) if words else None
        if item.endswith("*"):
            words = re.findall(r"\w+", folded(item[:-1]))
            return Node("prefix", words) if len(words) == 1 else None
        words = re.findall(r"\w+", folded(item))
        return None if not words else Node("term", words) if len(words) == 1 else Node("phrase", words)

    tree = either()
    return tree if at == len(items) else None


def matching(postings: DataFrame, key: str, tree: Node) -> DataFrame:
    """Distinct keys of what a query's tree finds."""
    if tree.kind == "term":
        return postings.filter(F.col("token") == tree.parts[0]).select(key).distinct()
    if tree.kind == "prefix":
        return postings.filter(F.col("token").startswith(tree.parts[0])).select(key).distinct()
    if tree.kind == "phrase":
        # each word says where the phrase would begin; all words must say the same place
        places = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(tree.parts)])
        hits = postings.filter(F.col("token").isin(*set(tree.parts))).withColumn("p", F.explode(F.filter(places, lambda x: x["w"] == F.col("token"))))
        starts = hits.groupBy(key, "field", (F.col("pos") - F.col("p.i")).alias("start")).agg(F.count_distinct("p.i").alias("n"))
        return starts.filter(F.col("n") == len(tree.parts)).select(key).distinct()
    found = [matching(postings, key, p) for p in tree.parts]
    if tree.kind == "or":
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out.distinct()
    return found[0].join(found[1], key, "left_semi" if tree.kind == "and" else "left_anti")


def condition(tree: Node, fields: list[Column]) -> Column:
    """Whether a query's tree holds for a row, from the token arrays of its fields."""
    either = lambda test: F.coalesce(F.array_max(F.array(*[test(f) for f in fields])), F.lit(False))
    if tree.kind == "term":
        return either(lambda f: F.array_contains(f, tree.parts[0]))
    if tree.kind == "prefix":
        return either(lambda f: F.exists(f, lambda w: w.startswith(tree.parts[0])))
    if tree.kind == "phrase":
        return either(lambda f: F.concat(F.lit(" "), F.array_join(f, " "), F.lit(" ")).contains(f" {' '.join(tree.parts)} "))
    found = [condition(p, fields) for p in tree.parts]
    if tree.kind == "or":
        out = found[0]
        for f in found[1:]:
            out = out | f
        return out
    return found[0] & found[1] if tree.kind == "and" else found[0] & ~found[1]


def search(df: DataFrame, query: str, columns: tuple[str, ...] = ("title", "company", "summary", "recommendations")) -> DataFrame:
    """Rows that a query finds, each judged by itself in one scan; ``indexed`` is the way with a stored index."""
    tree = parsed(query)
    if tree is None:
        return df.limit(0)
    # the arrays are bound to the argument of a function, so that a text is cut into tokens once
    fields = F.struct(*[tokens(F.col(c)).alias(f"f{i}") for i, c in enumerate(columns)])
    hit = F.transform(F.array(fields), lambda x: condition(tree, [x[f"f{i}"] for i in range(len(columns))]))
    return df.filter(F.get(hit, F.lit(0)))


def indexed(df: DataFrame, postings: DataFrame, query: str, key: str = "job_id") -> DataFrame:
    """Rows that a query finds through an index of postings."""
    tree = parsed(query)
    return df.limit(0) if tree is None else df.join(matching(postings, key, tree), key, "left_semi")


def keyword(df: DataFrame, query: str, low: float = 0, high: float = 100, company: str | None = None, limit: int = 20) -> DataFrame:
    """Found assessments in a range of scores, the best first."""
    out = search(df, query).filter(F.col("overall_score").between(low, high))
    if company is not None:
        out = out.filter(F.col("company") == company)
    return out.orderBy(F.desc("overall_score"), "job_id").limit(limit)


def search_or_like(df: DataFrame, query: str, columns: tuple[str, ...] = ("title", "company", "summary", "recommendations")) -> DataFrame:
    """As ``search``, with a plain substring of any column where the query is malformed."""
    if parsed(query) is not None or not query.strip():
        return search(df, query, columns)
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(c).contains(query.strip().lower()), F.lit(False))
    return df.filter(found)


def stemmed(word: Column) -> Column:
    """A word without common English endings: plurals, -ed, -ing, -ly, -ness, -ment, -ation."""
    out = F.lower(word)
    for pattern, by in [(r"sses$", "ss"), (r"ies$", "i"), (r"(?<=[^su])s$", ""), (r"(?<=[aeiouy].{1,20})(?:ed|ing)$", ""), (r"(?<=.{3})(?:ly|ness|ment)$", ""), (r"(?<=.{3})ation$", "ate"), (r"([^aeioulsz])\1$", "$1")]:
        out = F.regexp_replace(out, pattern, by)
    return out
