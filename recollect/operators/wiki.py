"""Validation of Markdown pages: names, front matter, links within the vault."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions import constants as C

REQUIRED = ("title", "created", "updated")


def pages(files: DataFrame) -> DataFrame:
    """files (path, content) with name, stem, front matter and body; the latter two null without closed front matter."""
    name = F.element_at(F.split("path", "/"), -1)
    parts = F.split("content", "---", 3)
    opened = F.col("content").startswith("---\n") | F.col("content").startswith("---\r\n")
    out = files.withColumn("name", name).withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", "")).withColumn("suffix", F.regexp_extract("name", r"(\.[^.]*)$", 1)).withColumn("opened", opened).withColumn("parts", parts)
    closed = F.col("opened") & (F.size("parts") == 3)
    return out.withColumn("front", F.when(closed, F.element_at("parts", 2))).withColumn("body", F.when(F.size("parts") == 3, F.element_at("parts", 3))).drop("parts")


def has_field(name: str):
    """A top-level ``name: value`` line of the front matter, with a value."""
    return F.coalesce(F.col("front").rlike(rf"(?m)^{name}:[ \t]*\S"), F.lit(False))


def links(parsed: DataFrame) -> DataFrame:
    """(path, link): links of the body, repeats included."""
    return parsed.select("path", F.explode(F.regexp_extract_all("body", F.lit(C.WIKI_LINK), F.lit(1))).alias("link"))


def unresolved(parsed: DataFrame) -> DataFrame:
    """Links to pages that are not there."""
    there = parsed.filter("suffix = '.md'").select(F.col("stem").alias("link")).distinct()
    return links(parsed).join(there, "link", "left_anti")


def violations(files: DataFrame) -> DataFrame:
    """(path, rule, message) of all rules a page breaks; a page with a wrong suffix or without front matter is not looked into further."""
    p = pages(files)
    md = F.col("suffix") == ".md"
    missing = F.filter(F.array(*[F.when(~has_field(n), n) for n in REQUIRED]), lambda n: n.isNotNull())
    count = F.size(F.regexp_extract_all("body", F.lit(C.WIKI_LINK), F.lit(1)))
    rule = lambda test, name, message: F.when(test, F.struct(F.lit(name).alias("rule"), message.alias("message")))
    found = F.array(
        rule(~F.col("stem").rlike(C.KEBAB_CASE), "naming", F.concat(F.lit("not in kebab case: "), "name")), rule(~md, "naming", F.concat(F.lit("not a .md file: "), "name")),
        rule(md & ~F.col("opened"), "frontmatter", F.lit("front matter does not begin the page")), rule(md & F.col("opened") & F.col("front").isNull(), "frontmatter", F.lit("front matter is not closed")),
        rule(md & F.col("front").isNotNull() & (F.size(missing) > 0), "frontmatter", F.concat(F.lit("missing: "), F.array_join(missing, ", "))), rule(md & F.col("front").isNotNull() & (count == 0), "links", F.lit("no outgoing link")),
    )
    own = p.select("path", F.explode(F.filter(found, lambda v: v.isNotNull())).alias("v")).select("path", "v.rule", "v.message")
    return own.unionByName(unresolved(p).select("path", F.lit("unresolved_link").alias("rule"), F.concat(F.lit("no page for [["), "link", F.lit("]]")).alias("message")))
