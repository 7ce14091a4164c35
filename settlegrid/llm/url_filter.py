"""Block and allow rules on urls, carried over redirects and canonical links by connected components. No Python on executors."""
from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, connected_components, stored

#: (verdict, host and path), as given: allow com/, block example.com/en/, allow www.example.com/en/, block net/es/ and net/fr/.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
ATTRIBUTE = "([^\\s\"'<>/=]+)\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>]+))"
REFRESH = "(?is)^\\s*+[\\d.]*+\\s*+[;,]?+\\s*+(?:url\\s*+=\\s*+)?+(?:\"([^\"]*)|'([^']*)|([^\"'].*))"
BASE_TAG = "(?i)<base\\b[^>]*\\bhref\\b[^>]*>"
LINK_TAG = ("(?i)<link\\b[^>]*\\brel\\s*=\\s*(?:\"(?:[^\">]*\\s)?canonical(?=[\\s\"])|'(?:[^'>]*\\s)?canonical(?=[\\s'])"
            "|canonical(?=[\\s/>]))[^>]*>")
COMMENT = "(?s)<!--.*?(?:-->|\\z)"
REFRESH_TAG = "(?i)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b[^>]*>"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits host and path, or null. Allow comes first among equals."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow")):
        at = rule.index("/")
        name, start = rule[:at], rule[at:]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def address(url: Column) -> Column:
    """What two urls of one page have in common: scheme, fragment and letter case of the host do not count."""
    query = F.regexp_extract(url, "(?s)^[^#?]*(\\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), path_of(url), F.coalesce(query, F.lit(""))))


def attribute(tag: Column, name: str) -> Column:
    """Value of the tag's first attribute of that name in any letter case, ``&amp;`` read as ``&``; none: null."""
    found = F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), lambda x: ascii_lower(F.regexp_extract(x, ATTRIBUTE, 1)) == name)
    first = F.try_element_at(found, F.lit(1))
    return F.replace(F.concat(*[F.regexp_extract(first, ATTRIBUTE, k) for k in (2, 3, 4)]), F.lit("&amp;"), F.lit("&"))


def without_dots(path: Column) -> Column:
    """A path that starts with ``/``, its segments ``.`` and ``..`` carried out."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == ".", done).when(
        x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))))
    end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("/"), F.array_join(F.concat(kept, end), "/"))


def resolve(reference: Column, base: Column) -> Column:
    """The url that ``reference`` means on a page at ``base``; null if it is empty or of another scheme than http and https.

    Absolute (scheme in any case), ``//host/x``, ``/x``, ``x`` and ``../x``, ``?x`` and ``#x``.
    """
    ref = F.trim(F.regexp_replace(reference, "[\\t\\n\\r]", ""))
    site = F.regexp_extract(base, "(?s)^(.*?://[^/?#]*)", 1)
    way, rest = F.regexp_extract(ref, "(?s)^([^?#]*)", 1), F.regexp_extract(ref, "(?s)^[^?#]*(.*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(base), "(?s)^/(.*/)", 1))
    query = F.regexp_extract(base, "(?s)^[^#?]*(\\?[^#]*)", 1)
    return (F.when(ref == "", None).when(ref.rlike("(?i)^https?://"), ref).when(ref.rlike("(?i)^[a-z][a-z0-9+.-]*:"), None)
            .when(ref.startswith("//"), F.concat(F.lit("http:"), ref))
            .when(ref.startswith("/"), F.concat(site, without_dots(way), rest))
            .when(ref.startswith("?"), F.concat(site, path_of(base), rest))
            .when(ref.startswith("#"), F.concat(site, path_of(base), query, rest))
            .otherwise(F.concat(site, without_dots(F.concat(folder, way)), rest)))


def _node(place: Column) -> Column:
    return F.substring(F.sha2(place.cast("binary"), 256), 1, 32)


def page_edges(pages: DataFrame, url="url", html="html") -> DataFrame:
    """(a, b): node of a page and node of each url that it names as its canonical form or sends its reader on to, once each.

    Targets are read from ``href`` and from ``content``, and are resolved against the page's url or its base tag. ``canonical``
    may be one of several words of ``rel``. What stands in an html comment (an open one ends with the text) names nothing.
    """
    named = pages.where(F.col(html).rlike(LINK_TAG) | F.col(html).rlike(REFRESH_TAG)).select(
        F.col(url).alias("url"), F.regexp_replace(html, COMMENT, "").alias("html"))
    base = resolve(attribute(F.regexp_extract("html", BASE_TAG, 0), "href"), F.col("url"))
    tags = F.concat(*[F.regexp_extract_all("html", F.lit(t), F.lit(0)) for t in (LINK_TAG, REFRESH_TAG)])
    named = named.select(address(F.col("url")).alias("a"), F.coalesce(base, "url").alias("base"), F.explode(tags).alias("t"))
    sent = attribute(F.col("t"), "content")
    sent = F.concat(*[F.regexp_extract(sent, REFRESH, k) for k in (1, 2, 3)])
    ref = F.when(F.col("t").rlike("(?i)^<link"), attribute(F.col("t"), "href")).otherwise(sent)
    named = named.select("a", address(resolve(ref, F.col("base"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    return named.select(_node(F.col("a")).alias("a"), _node(F.col("b")).alias("b"), F.col("a").alias("place_a"),
                        F.col("b").alias("place_b"))


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame = None, id_col="page_id", url_col="url",
               html_col="html") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    The longest fitting rule decides. A page without a rule takes the verdict of its aliases: pages and targets joined
    by canonical links, refresh redirects in the html (absolute or relative, see :func:`resolve`), or rows of ``redirects`` (from_url, to_url). An explicit allow
    anywhere among the aliases comes before any block; a block comes before nothing at all; otherwise allow. Pages
    with one address are aliases of each other (their rule is the same). Null or odd urls have an empty host and
    path, fit no rule and have no aliases: allow. Empty tables give an empty result; other columns are not read.
    """
    url = F.col(url_col)
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"),
                          address(url).alias("place"))
    judged = judged.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    links = page_edges(pages, url_col, html_col)
    if redirects is not None:
        sent = redirects.select(address(F.col("from_url")).alias("a"), address(F.col("to_url")).alias("b"))
        sent = sent.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        links = links.unionByName(sent.select(_node(F.col("a")).alias("a"), _node(F.col("b")).alias("b"),
                                              F.col("a").alias("place_a"), F.col("b").alias("place_b")))
    links = stored(links)
    groups = connected_components(links)
    # rules at both ends of every edge decide a component; its verdict is one small aggregate that combines on the map side
    ends = links.select("a", "place_a").unionByName(links.select(F.col("b").alias("a"), F.col("place_b").alias("place_a")))
    ends = ends.distinct().withColumn("url", F.concat(F.lit("x://"), "place_a"))
    said = ends.withColumn("said", rule_for(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"])
    groups = stored(said.join(groups, said["a"] == groups["node"]).select("node", "component", "said"))
    verdicts = groups.groupBy("component").agg(F.bool_or(F.col("said") == "allow").alias("allowed"),
                                               F.bool_or(F.col("said") == "block").alias("blocked"))
    fate = groups.select("node", "component").distinct().join(verdicts, "component").select(
        "node", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("fate"))
    out = judged.withColumn("node", _node(F.col("place"))).join(fate, "node", "left")
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"),
                      F.coalesce("found.verdict", "fate", F.lit("allow")).alias("verdict"))
