"""URL rules with redirect equivalence, in DataFrame functions only.

A rule is a host and the start of a path, like ``example.com/en/``; it fits its host and all subdomains where the path
starts with the rule's. The longest rule that fits judges a url by itself. A url that no rule fits takes the decision of
its aliases: the urls it is connected with by redirect and canonical links, at any distance and in either direction. An
explicit allow comes before a block, both on the url itself and among its aliases; without any rule the verdict is allow.

Links are the canonical links and the refresh targets of a page's html, and any further pairs that are given. Only markup
counts: comments, scripts, styles and other raw text are left out, attributes are read one by one as browsers do, the first
of a name counts, rel is a list of words. Targets are resolved against the page, or its base element; those of another
scheme than http and https are no links. Nodes are host, path without dot segments and query, without scheme and fragment;
an empty path is ``/``. A url that fits a rule only in this form has that rule's decision before its aliases'.

A null url, or one without ``://``, has empty host and path, no rule and no aliases. Repeated urls are one node, repeated
rows each get a verdict, an empty table gives no rows, extra columns are ignored. Html that is null has no links.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import lookup_join, materialise
from parley.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

SPACE = r"[ \t\n\f\r]"
RAW = "script style textarea title template iframe xmp noembed noframes".split()
#: What holds no markup: comments and raw text.
UNSEEN = r"(?is)<!--(?:-?>|.*?(?:-->|\z))|" + "|".join(rf"<{t}\b.*?(?:</{t}\b|\z)" for t in RAW)
#: A tag that may link, quoted values whole. Possessive, so that the JVM takes no stack for it; ``*+`` is ``*`` elsewhere.
TAG = rf"""(?i)<(?:link|meta|base)[ \t\n\f\r/][^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>"""
#: An attribute with its value, quoted or not.
ATTRIBUTE = rf"""[^ \t\n\f\r"'>/=][^ \t\n\f\r>/=]*(?:{SPACE}*={SPACE}*(?:"[^"]*"|'[^']*'|[^ \t\n\f\r"'>][^ \t\n\f\r>]*))?"""
NAME = r"^[^ \t\n\f\r=]+"
VALUE = rf"(?s)^[^=]*={SPACE}*(.*)$"
QUOTED = r"""(?s)^["'](.*)["']$"""
#: The target in the content of a refresh.
REFRESH = rf"""(?is)^[0-9. \t\n\f\r]*[0-9][0-9.]*{SPACE}*[;, \t\n\f\r]{SPACE}*(?:url{SPACE}*={SPACE}*)?["']?([^"' \t\n\f\r]*)"""
AMPERSAND = "(?i)&(?:amp|#38|#x26);"
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"
HTTP = "(?i)^https?://"


def rest_of(url: Column) -> Column:
    """What follows the first ``://``, empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def without_dots(path: Column) -> Column:
    """A path without its segments ``.`` and ``..``, ``/`` for an empty one."""

    def kept(parts: Column) -> Column:
        parts = F.concat(F.slice(parts, 2, F.size(parts)), F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
        shorter = lambda held: F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))
        return F.aggregate(parts, F.array().cast("array<string>"), lambda held, x: F.when(x == "..", shorter(held)).when(x == ".", held).otherwise(F.concat(held, F.array(x))))

    return F.when(path == "", "/").when(path.contains("/."), F.concat(F.lit("/"), F.array_join(bound(F.split(path, "/"), kept), "/"))).otherwise(path)


def node_of(rest: Column) -> Column:
    """Host in lower case, path and query; null for an empty host."""
    whole = lambda r: F.concat(host_of(r), bound(path_of(r), without_dots), F.regexp_extract(r, "^[^?#]*([^#]*)", 1))
    return bound(rest, lambda r: F.when(r.rlike("^[^/?#]"), whole(r)))


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null without one; of equal rules allow comes first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow")):
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def resolved(href: Column, node: Column) -> Column:
    """The node that a link of a page leads to; null for another scheme."""
    return node_of(
        bound(
            href,
            lambda h: F.when(h.rlike(HTTP), rest_of(h))
            .when(h.rlike(SCHEME), "")
            .when(h.startswith("//"), F.substr(h, F.lit(3)))
            .when(h.startswith("/"), F.concat(F.regexp_extract(node, "^[^/?]*", 0), h))
            .when(h.startswith("?"), F.concat(F.regexp_extract(node, "^[^?]*", 0), h))
            .when((h == "") | h.startswith("#"), node)
            .otherwise(F.concat(F.regexp_extract(node, "^[^?]*/", 0), h)),
        )
    )


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, empty without one."""
    named = F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), lambda a: F.lower(F.regexp_extract(a, NAME, 0)) == name)
    value = F.regexp_extract(F.coalesce(F.get(named, 0), F.lit("")), VALUE, 1)
    value = F.regexp_replace(F.regexp_replace(value, QUOTED, "$1"), AMPERSAND, "&")
    return F.trim(value, F.lit(" \t\n\f\r"))


def page_links(pages: DataFrame) -> DataFrame:
    """a, b: nodes of a page and of its canonical and refresh targets."""
    html = F.regexp_replace(F.col("html").cast("string"), UNSEEN, " ")
    tags = F.regexp_extract_all(html, F.lit(TAG), F.lit(0))
    rows = pages.where(F.col("html").isNotNull() & F.col("url").isNotNull()).select(node_of(rest_of(F.col("url").cast("string"))).alias("a"), tags.alias("tags"))
    rows = rows.where("a is not null and size(tags) > 0")
    # The first base element that has a target counts.
    bases = F.filter(F.transform(F.filter("tags", lambda t: F.lower(F.substr(t, F.lit(1), F.lit(5))) == "<base"), lambda t: attribute(t, "href")), lambda x: x != "")
    based = F.coalesce(resolved(F.get(bases, 0), F.col("a")), F.col("a"))
    rows = rows.select("a", based.alias("base"), F.explode("tags").alias("tag"))
    kind, tag = F.lower(F.substr("tag", F.lit(1), F.lit(5))), F.col("tag")
    canonical = (kind == "<link") & F.array_contains(F.split(F.lower(attribute(tag, "rel")), f"{SPACE}+"), "canonical")
    refresh = (kind == "<meta") & (F.lower(attribute(tag, "http-equiv")) == "refresh")
    href = F.when(canonical, attribute(tag, "href")).when(refresh, F.regexp_extract(attribute(tag, "content"), REFRESH, 1))
    return rows.select("a", "base", href.alias("href")).where("href != ''").select("a", resolved(F.col("href"), F.col("base")).alias("b")).where("a != b")


def node_verdict(node: Column, rules: Sequence[tuple[str, str]]) -> Column:
    return ruled(F.regexp_extract(node, "^[^/?]*", 0), F.regexp_extract(node, "^[^/?]*([^?]*)", 1), rules)[1]


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every row. redirects: further links, columns from_url and to_url."""
    rest = rest_of(F.coalesce(F.col("url").cast("string"), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(rest).alias("host"), path_of(rest).alias("path"), node_of(rest).alias("node"))
    rule, own = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "own": own})

    links = page_links(pages)
    if redirects is not None:
        ends = [node_of(rest_of(F.col(c).cast("string"))).alias(n) for c, n in (("from_url", "a"), ("to_url", "b"))]
        links = links.unionByName(redirects.select(*ends).where("a != b"))
    classes = materialise(components(links, "a", "b"))
    decided = classes.groupBy("root").agg(F.min(node_verdict(F.col("node"), rules)).alias("alias_verdict"))  # allow sorts before block
    sizes = classes.groupBy("root").agg(F.count("*").alias("members"))
    facts = lookup_join(classes, decided.join(sizes, "root"), "root", "members", classes.count()).where("alias_verdict is not null").select("node", "alias_verdict")

    alone = rows.where("rule is not null or node is null").withColumn("alias_verdict", F.lit(None).cast("string"))
    open_ = rows.where("rule is null and node is not null")
    counts = open_.groupBy("node").agg(F.count("*").alias("weight"))
    facts = facts.join(counts, "node")
    found = lookup_join(open_, facts, "node", "weight", pages.count())
    out = alone.unionByName(found.select(*alone.columns))
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", node_verdict(F.col("node"), rules), "alias_verdict", F.lit("allow")).alias("verdict"))


def oracle(rules: Sequence[tuple[str, str]] = RULES, table: str = "pages") -> str:
    """The verdicts in DuckDB's SQL, aliases by recursion over the links."""

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("*+", "*").replace("'", "''") + "'"

    def rest(x: str) -> str:
        return f"case when instr({x}, '://') > 0 then substr({x}, instr({x}, '://') + 3) else '' end"

    def host(x: str) -> str:
        return f"translate(regexp_extract({x}, '^[^/?#]*'), '{UPPER}', '{LOWER}')"

    def path(x: str) -> str:
        return f"regexp_extract({x}, '^[^/?#]*([^?#]*)', 1)"

    def plain(x: str) -> str:
        parts = f"string_split({x}, '/')"
        parts = f"(case when {parts}[-1] in ('.', '..') then list_append({parts}, '') else {parts} end)[2:]"
        kept = f"list_reduce(list_prepend(cast([] as varchar[]), list_transform({parts}, lambda x: [x])), lambda held, x: case x[1] when '..' then held[1:greatest(len(held) - 1, 0)] when '.' then held else list_concat(held, x) end)"
        return f"case when {x} = '' then '/' when contains({x}, '/.') then '/' || array_to_string({kept}, '/') else {x} end"

    def node(x: str) -> str:
        return f"case when {host(x)} <> '' then {host(x)} || {plain(path(x))} || regexp_extract({x}, '^[^?#]*([^#]*)', 1) end"

    def target(href: str, at: str) -> str:
        return f"""case when {href} is null then null when regexp_matches({href}, {quoted(HTTP)}) then {rest(href)} when regexp_matches({href}, {quoted(SCHEME)}) then ''
    when starts_with({href}, '//') then substr({href}, 3) when starts_with({href}, '/') then regexp_extract({at}, '^[^/?]*') || {href}
    when starts_with({href}, '?') then regexp_extract({at}, '^[^?]*') || {href} when {href} = '' or starts_with({href}, '#') then {at}
    else regexp_extract({at}, '^[^?]*/') || {href} end"""

    def attribute(tag: str, name: str) -> str:
        value = f"coalesce(list_filter(regexp_extract_all({tag}, {quoted(ATTRIBUTE)}), lambda z: lower(regexp_extract(z, {quoted(NAME)})) = '{name}')[1], '')"
        value = f"regexp_replace(regexp_extract({value}, {quoted(VALUE)}, 1), {quoted(QUOTED)}, '\\1')"
        return f"trim(regexp_replace({value}, {quoted(AMPERSAND)}, '&', 'g'), ' ' || chr(9) || chr(10) || chr(12) || chr(13))"

    def case(what: int, h: str, p: str) -> str:
        arms = []
        for r in sorted(rules, key=lambda r: (-len(r[1]), r[0] != "allow")):
            domain, slash, start = r[1].partition("/")
            arms.append(f"when ({h} = '{domain}' or ends_with({h}, '.{domain}')) and starts_with({p}, '{slash}{start}') then '{r[what]}'")
        return f"case {' '.join(arms)} end"

    def by_node(x: str) -> str:
        return case(0, f"regexp_extract({x}, '^[^/?]*')", f"regexp_extract({x}, '^[^/?]*([^?]*)', 1)")

    return f"""
with recursive p as (
  select page_id, html, {rest("coalesce(url, '')")} as rest from {table}),
q as (
  select page_id, html, {host("rest")} as host, {path("rest")} as path, {node("rest")} as node from p),
g0 as (
  select node as a, regexp_extract_all(regexp_replace(html, {quoted(UNSEEN)}, ' ', 'g'), {quoted(TAG)}) as tags from q where node is not null),
g1 as (
  select a, tags, list_filter(list_transform(list_filter(tags, lambda t: lower(t[1:5]) = '<base'), lambda t: {attribute("t", "href")}), lambda x: x <> '')[1] as based from g0),
g2 as (select a, tags, {target("based", "a")} as based from g1),
g3 as (select a, coalesce({node("based")}, a) as base, unnest(tags) as tag from g2),
h as (
  select a, base, case
    when lower(tag[1:5]) = '<link' and list_contains(regexp_split_to_array(lower({attribute("tag", "rel")}), {quoted(SPACE + "+")}), 'canonical') then {attribute("tag", "href")}
    when lower(tag[1:5]) = '<meta' and lower({attribute("tag", "http-equiv")}) = 'refresh' then regexp_extract({attribute("tag", "content")}, {quoted(REFRESH)}, 1) end as href
  from g3),
t as (select a, {target("href", "base")} as whole from h where href <> ''),
e as (select distinct a, {node("whole")} as b from t),
g as (select a, b from e where b is not null and a <> b union select b, a from e where b is not null and a <> b),
reach as (select a as node, a as other from g union select r.node, g.b from reach r join g on r.other = g.a),
s as (
  select node, min({by_node("other")}) as alias_verdict
  from reach group by node)
select q.page_id, q.host, q.path, {case(1, "q.host", "q.path")} as rule,
  coalesce({case(0, "q.host", "q.path")}, {by_node("q.node")}, s.alias_verdict, 'allow') as verdict
from q left join s on q.node = s.node"""
