"""URL verdicts by host and path rules, carried over redirects and canonical links."""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .lines import LOWER, UPPER
from ..sources.shared import save


def host_of(url: Column) -> Column:
    """What stands between the first `://` and `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. Of equally long ones an allow wins."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow", r[0], r[1]))
    fits = [(r, ((host == r[0]) | F.endswith(host, F.lit("." + r[0]))) & F.startswith(path, F.lit(r[1]))) for r in ordered]
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for (h, p, v), fit in reversed(fits):
        out = F.when(fit, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(out)
    return out


#: Fixed values (none looks twice for an end that isn't there): what may name an alias, and what never counts: comments, scripts, styles and templates.
SKIPPED = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style|template|noscript|textarea|title)(?=[\s/>])[^>]*+(?:>.*?(?:</\1(?=[\s/>])|\Z)|\Z)", re.S | re.I)
ELEMENT = re.compile(r"<(link|meta|base)(?=[\s/])((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)", re.I)
ATTRIBUTE = re.compile(r"(?<![^\s=\"'/])([^\s=\"'/]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
REFRESH = re.compile(r"\burl\s*+=\s*+[\"']?\s*+([^\"'\s;]+)", re.I)


def linked(page: str, url: str) -> list[str]:
    """Absolute addresses that a page names as canonical or refreshes to, in order.

    Attribute values have their character references decoded. The first base element with an address is what
    relative ones are resolved against, by RFC 3986; without it that is the page's own.
    """
    base, found = None, []
    for m in ELEMENT.finditer(SKIPPED.sub(" ", page)):
        tag, a = m[1].lower(), {}
        for k, *values in ATTRIBUTE.findall(m[2]):
            a.setdefault(k.lower(), entities.unescape("".join(values)).strip())
        if tag == "base":
            base = base or a.get("href")
        elif tag == "link" and "canonical" in a.get("rel", "").lower().split():
            found.append(a.get("href"))
        elif tag == "meta" and a.get("http-equiv", "").lower() == "refresh" and (to := REFRESH.search(a.get("content", ""))):
            found.append(to[1])
    out = []
    for to in filter(None, found):
        try:
            out.append(urljoin(urljoin(url, base or ""), to))
        except ValueError:  # an address that can't be read, such as a broken IPv6 host
            continue
    return out


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): a page's address and the one, made absolute, that it names as canonical or refreshes to.

    Few pages hold such a word at all; only those leave the JVM.
    """

    def run(batches):
        for x in batches:
            pairs = [(url, to) for url, page in zip(*(c.to_pylist() for c in x.columns), strict=True) for to in linked(page, url)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*pairs, strict=True) if pairs else ([], []))], ["a", "b"])

    marked = pages.where(F.contains(url_col, F.lit("://")) & F.col(html_col).rlike("(?i)canonical|http-equiv"))
    return marked.select(url_col, html_col).mapInArrow(run, "a string, b string").where("b like '%://%'")


def address(url: Column) -> Column:
    """What two spellings of one address share: the host in lower case, no fragment, an empty path as /."""
    rest = F.regexp_extract(url, "://[^/?#]*([^#]*)", 1)
    return F.concat(host_of(url), F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest)))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each page.

    `rules` are (host, path, allow or block). A rule fits its host and all subdomains where the path starts
    with the rule's; the longest wins and settles the verdict. Addresses linked by a redirect (rows from, to of
    `redirects`, refresh elements) or a canonical link are aliases. A page without a rule takes the verdict
    of its aliases: allow if a rule allows any of them, else block if a rule blocks any, else allow.

    An alias counts whether or not it is a page of the table. A null URL, or one without `://`, has an empty
    host and path, no rule and no alias, and is allowed. Repeated rows are judged each for itself.
    """
    url = F.col(url_col)
    judged = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.when(F.contains(url, F.lit("://")), address(url)).alias("at"))
    judged = judged.withColumn("r", best_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "at", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("own"))
    links = page_links(pages, url_col, html_col)
    if redirects is not None:
        links = links.union(redirects.select(F.col("from").alias("a"), F.col("to").alias("b")).where("a like '%://%' and b like '%://%'"))
    links = save(links.select(address(F.col("a")).alias("a"), address(F.col("b")).alias("b")), "aliases")
    if links.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    roots = save(connected_components(links), "alias-roots")
    full = F.concat(F.lit("http://"), F.col("node"))
    votes = roots.withColumn("v", best_rule(host_of(full), path_of(full), rules)["verdict"]).groupBy("root").agg(F.min("v").alias("v")).where("v is not null")  # allow sorts before block
    given = save(votes.withColumnRenamed("root", "_root"), "alias-votes")
    taken = save(roots.join(given, F.col("root") == F.col("_root")).select("node", F.col("v").alias("passed")), "alias-verdicts")
    return judged.join(taken, F.col("at") == F.col("node"), "left").select("page_id", "host", "path", "rule", F.coalesce("own", "passed", F.lit("allow")).alias("verdict"))
