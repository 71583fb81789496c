"""URL filters whose block decisions reach a page's aliases.

Rules judge urls by host and path. Urls that are the same page by redirects or canonical links are one class: spellings of one url
share a key (see ``alias_key``), and the keys are joined by edges from canonical links and refreshes in the pages and from a table of
redirects. The classes are the connected components of these edges. A url without a rule of its own is blocked if its class
holds a url that a rule blocks and none that a rule allows: an explicit allow comes before a block, and a url's own rule before both.
DataFrame functions only; the html is read once, for the edges alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .graph import components

#: Rules are tests in the plan, one after the other: a parameter of at most so many.
MAX_RULES = 1000
#: Rows of a hot url are dealt out to so many joins.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))

#: scheme, host, path and query of a url, which has a "://"
URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?"
#: Parameters of a query that tell where a visitor came from and not which page it is.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
CANONICAL_TAG = r"(?is)<link\b[^<>]*\brel\s*=\s*[\"']?canonical\b[^<>]*>"
REFRESH_TAG = r"(?is)<meta\b[^<>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^<>]*>"
HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
CONTENT = r"(?is)\bcontent\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
REFRESH_URL = r"(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*['\"]?\s*([^'\"]*)"


def _part(url: Column, k: int) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, k), F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark, number sign or the end, A-Z lower-cased; empty for a null or other text."""
    return F.translate(_part(url, 2), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return _part(url, 3)


def alias_key(url: Column) -> Column:
    """One spelling for urls of one page: http as https, host in lower case without a default port, no slashes at the path's end, no
    tracking parameters, no fragment. A text without ``://`` is its own key; null stays null."""
    scheme = F.translate(_part(url, 1), UPPER, LOWER)
    host = F.regexp_replace(host_of(url), r":(80|443)?$", "")
    asked = F.filter(F.split(F.substring(_part(url, 4), 2, 1 << 30), "&"), lambda x: (x != "") & ~x.rlike(TRACKING))
    query = F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise("")
    whole = F.concat(F.when(scheme == "http", "https").otherwise(scheme), F.lit("://"), host, F.regexp_replace(path_of(url), "/+$", ""), query)
    return F.when(F.instr(url, "://") > 0, whole).otherwise(url)


def resolved(href: Column, base: Column) -> Column:
    """A link's url as seen from the page ``base``: absolute, scheme-relative, from the root, a query alone or beside the page (dot segments
    stay). Null for an empty link, a fragment and schemes that name no page."""
    link = F.replace(F.trim(href), F.lit("&amp;"), F.lit("&"))
    root = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    folder = F.regexp_replace(path_of(base), "[^/]*$", "")
    return (
        F.when((link == "") | link.startswith("#"), F.lit(None))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("//"), F.concat(_part(base, 1), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, path_of(base), link))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )


def _attribute(tag: Column, pattern: str, groups: int) -> Column:
    return F.concat(*(F.regexp_extract(tag, pattern, k) for k in range(1, groups + 1)))


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst): each page's url and the urls that its first canonical link and first refresh name. pages: url, html."""
    canonical = _attribute(F.regexp_extract("html", CANONICAL_TAG, 0), HREF, 3)
    refresh = F.regexp_extract(_attribute(F.regexp_extract("html", REFRESH_TAG, 0), CONTENT, 2), REFRESH_URL, 1)
    links = pages.where("url is not null and html is not null").select(F.col("url").alias("src"), F.explode(F.array(canonical, refresh)).alias("href")).where("href <> ''")
    return links.select("src", resolved(F.col("href"), F.col("src")).alias("dst"))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """(name, verdict) of the longest rule that fits: its host or a subdomain, and a path that starts with its path. Of rules of equal
    length that fit, one that allows. Null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow")):  # the last test is asked first
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, own_class (whether the verdict came from the url's class) for every row of ``pages`` (page_id, url, html).

    redirects: urls src and dst, as a crawl has seen them; rows with a null are left out. A null url has no host, no rule and no alias
    and is allowed; null html has no links; repeated rows are judged each; an empty table gives an empty table; other columns are not
    read. Of rules that tie in length an allow wins, and in a class with both an allow and a block the urls without a rule are
    allowed. One row for each url key is shuffled, not the pages; the pages without a rule are joined to the blocked keys."""
    rows = pages.select("page_id", F.col("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("key", alias_key(F.col("url")))
    links = page_links(pages) if redirects is None else page_links(pages).union(redirects.select("src", "dst"))
    links = materialize(links.where("src is not null and dst is not null").distinct(), "links")
    classes = components(links.select(alias_key(F.col("src")).alias("a"), alias_key(F.col("dst")).alias("b")))
    # a url that only links name may have a rule as well, though no page
    ends = links.select(F.explode(F.array("src", "dst")).alias("url"))
    named = ends.select(alias_key(F.col("url")).alias("key"), rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("verdict"), F.lit(False).alias("open"))
    seen = rows.where("key is not null").select("key", F.col("hit.verdict").alias("verdict"), F.col("hit").isNull().alias("open"))
    flags = (F.max(F.col("verdict") == "allow"), F.max(F.col("verdict") == "block"))
    keys = seen.union(named).groupBy("key").agg(*(f.alias(n) for f, n in zip(flags, ("allows", "blocks"), strict=True)), F.max("open").alias("open"))
    keys = keys.join(classes, F.col("key") == F.col("node"), "left").select("key", F.coalesce("component", "key").alias("own"), "allows", "blocks", "open")
    # one row for each key, and of a class what its rules say: a hot class is pre-aggregated before the shuffle
    blocked = keys.groupBy("own").agg(F.max("allows").alias("allows"), F.max("blocks").alias("blocks")).where("blocks and not coalesce(allows, false)").select("own")
    aliases = keys.where("open").join(blocked, "own", "left_semi").select(F.col("key").alias("alias"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = rows.where("hit is not null").select("page_id", "host", "path", F.col("hit.name").alias("rule"), F.col("hit.verdict").alias("verdict"), F.lit(False).alias("own_class"))
    free = rows.where("hit is null").withColumn("dealt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    free = free.join(aliases, (F.col("key") == F.col("alias")) & (F.col("dealt") == F.col("salt")), "left")
    return own.unionByName(free.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("alias").isNull(), "allow").otherwise("block").alias("verdict"), F.col("alias").isNotNull().alias("own_class")))


def op11_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql(pattern: str) -> str:
    return pattern.replace("(?is)", "").replace("(?s)", "").replace("'", "''").replace('\\"', '"')


def _extract(text: str, pattern: str, group: int) -> str:
    return f"regexp_extract({text}, '{_sql(pattern)}', {group}, 'si')"


def _key_sql(url: str) -> str:
    scheme, host, path, query = (_extract(url, URL, k) for k in (1, 2, 3, 4))
    scheme, host = (f"translate({x}, '{UPPER}', '{LOWER}')" for x in (scheme, host))
    asked = f"array_to_string(list_filter(string_split(substr({query}, 2), '&'), lambda x: x <> '' and not regexp_matches(x, '{TRACKING}')), '&')"
    return f"case when instr({url}, '://') > 0 then case {scheme} when 'http' then 'https' else {scheme} end || '://' || regexp_replace({host}, ':(80|443)?$', '') || regexp_replace({path}, '/+$', '') || case when {asked} = '' then '' else '?' || {asked} end else {url} end"


def _rule_sql(host: str, path: str, what: str) -> str:
    order = sorted(RULES, key=lambda r: (-len(r.name), r.verdict != "allow"))
    return "case " + " ".join(f"when ({host} = '{r.host}' or ends_with({host}, '.{r.host}')) and starts_with({path}, '{r.path}') then '{getattr(r, what)}'" for r in order) + " end"


def _attribute_sql(tag: str, pattern: str, groups: int) -> str:
    return " || ".join(_extract(tag, pattern, k) for k in range(1, groups + 1))


_CANONICAL, _REFRESH = _attribute_sql(_extract("html", CANONICAL_TAG, 0), HREF, 3), _extract(f"({_attribute_sql(_extract('html', REFRESH_TAG, 0), CONTENT, 2)})", REFRESH_URL, 1)
_HOST, _PATH = f"translate({_extract('url', URL, 2)}, '{UPPER}', '{LOWER}')", _extract("url", URL, 3)
_ROOT = f"{_extract('src', URL, 1)} || '://' || {_extract('src', URL, 2)}"
_FOLDER = f"regexp_replace({_extract('src', URL, 3)}, '[^/]*$', '')"

# links of a page are resolved as in ``resolved``; the classes are walked from every key of a link
OP11_SQL = f"""
with recursive p as (select page_id, url, html, coalesce({_HOST}, '') as host, coalesce({_PATH}, '') as path, {_key_sql('url')} as key from pages),
r as (select *, {_rule_sql('host', 'path', 'name')} as rule, {_rule_sql('host', 'path', 'verdict')} as own from p),
h as (select url as src, replace(trim(unnest([{_CANONICAL}, {_REFRESH}])), '&amp;', '&') as link from pages where url is not null and html is not null),
l as (select src, case when link = '' or starts_with(link, '#') then null when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then link when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') then null
  when starts_with(link, '//') then {_extract('src', URL, 1)} || ':' || link when starts_with(link, '/') then {_ROOT} || link when starts_with(link, '?') then {_ROOT} || {_extract('src', URL, 3)} || link
  else {_ROOT} || case when {_FOLDER} = '' then '/' else {_FOLDER} end || link end as dst from h),
k as (select {_key_sql('src')} as a, {_key_sql('dst')} as b from l where dst is not null),
e as (select a, b from k union select b, a from k),
walk as (select a, b from e union select w.a, e.b from walk w join e on e.a = w.b),
c as (select a as key, least(a, min(b)) as own from walk group by a),
n as (select {_key_sql('url')} as key, {_rule_sql(_HOST, _PATH, 'verdict')} as own from (select src as url from l where dst is not null union all select dst from l where dst is not null)),
s as (select coalesce(c.own, x.key) as own, bool_or(x.own = 'allow') as allows, bool_or(x.own = 'block') as blocks from (select key, own from r where key is not null union all select key, own from n) x left join c using (key) group by 1)
select r.page_id, r.host, r.path, r.rule, coalesce(r.own, case when s.blocks and not coalesce(s.allows, false) then 'block' else 'allow' end) as verdict from r left join c using (key) left join s on s.own = coalesce(c.own, r.key)
"""
