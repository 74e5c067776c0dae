"""URL filters: rules on host and path, and the reputation of hosts for pages that no rule fits.

*Rules.*  A rule ``host/path`` fits its host and all subdomains if the url's path starts with the rule's; the longest
rule wins (ties: the longer host).  All rules of a url are found by looking its domain suffixes up in a map, without a join.

*Places.*  A host's public suffix is the longest one of ``SUFFIXES`` that it ends with, else its last label; its registered domain has
one label more.  IPv4 and bracketed IPv6 addresses are suffix and domain of their own.

*Reputation.*  Labelled pages give good and bad outcomes.  The share of bad pages is a beta-binomial at each level: the
suffix's prior is the overall share, the registered domain's prior the suffix's posterior mean, the host's prior the
domain's, each worth as many pages as the spread between the rows of its level shows (method of moments, 2 to 200
pages).  A page is blocked if its host's posterior mean minus ``z`` standard deviations is above ``limit``; a
host without labelled pages stands at its domain's share, with the prior's weight only.

Null urls and urls without ``://`` have an empty host and path; the empty host is a host of its own.  Rows are judged one
by one, so repeated rows agree.  Without labelled pages everything that no rule blocks is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
)
Z, LIMIT = 1.645, 0.5
LEAST, MOST = 2.0, 200.0
# Public suffixes of two labels under which names are registered; a bounded list, others can be passed.
SUFFIXES = tuple(f"{second}.{top}" for top, seconds in {
    "uk": "co org me ltd plc net sch ac gov", "au": "com net org edu gov id asn", "nz": "co net org ac govt school", "za": "co org net ac gov",
    "jp": "co ne or ac go ad ed gr lg", "kr": "co or ne re go ac pe", "in": "co net org gen firm ind ac gov", "br": "com net org gov edu",
    "mx": "com net org gob edu", "ar": "com net org gob edu", "co": "com net org gov edu", "cn": "com net org gov edu ac", "tw": "com net org gov edu idv",
    "hk": "com net org gov edu idv", "sg": "com net org gov edu per", "my": "com net org gov edu", "tr": "com net org gov edu bel", "il": "co org net ac gov muni",
    "id": "co or web ac go sch", "th": "co or in ac go net", "ua": "com net org gov edu", "pl": "com net org gov edu", "at": "co or ac gv", "es": "com nom org gob edu",
}.items() for second in seconds.split())
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    kept = F.regexp_replace(rest, "(?s)[?#].*", "")
    host = F.substring_index(kept, "/", 1)
    return F.translate(host, *LOWER), F.substring(kept, F.length(host) + 1, F.length(kept))


def suffixes(host: Column) -> Column:
    """The host and every domain above it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def best_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """Struct ``rule, verdict`` of the longest rule that fits, null if none does."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules:
        name, slash, start = rule.partition("/")
        by_host.setdefault(name, []).append((slash + start, rule, verdict))
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    known = F.create_map(*(x for name, own in by_host.items() for x in (
        F.lit(name), F.array(*(F.struct(F.lit(len(r)).alias("length"), F.lit(len(name)).alias("own"), F.lit(s).alias("start"), F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for s, r, v in own)))))
    lists = F.transform(F.filter(suffixes(host), lambda s: F.map_contains_key(known, s)), lambda s: known[s])
    best = F.array_max(F.filter(F.flatten(lists), lambda r: F.startswith(path, r["start"])))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def place(host: Column, public: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """Public suffix and registered domain, without port; a name that is a suffix itself, or an address, is its own domain."""
    bracketed = F.startswith(host, F.lit("["))
    name = F.when(bracketed, F.concat(F.substring_index(host, "]", 1), F.lit("]"))).otherwise(F.substring_index(host, ":", 1))
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    whole = bracketed | F.rlike(name, F.lit(rf"^({octet}\.){{3}}{octet}$"))
    suffix, domain = F.substring_index(name, ".", -1), F.substring_index(name, ".", -2)
    for n in sorted({s.count(".") + 1 for s in public}):  # longer ones win
        known = F.substring_index(name, ".", -n).isin(*(s for s in public if s.count(".") + 1 == n))
        suffix = F.when(known, F.substring_index(name, ".", -n)).otherwise(suffix)
        domain = F.when(known, F.substring_index(name, ".", -n - 1)).otherwise(domain)
    return F.when(whole, name).otherwise(suffix), F.when(whole, name).otherwise(domain)


def _shrink(rows: DataFrame) -> DataFrame:
    """Beta posterior ``a, b`` of each row's bad share around the prior mean in column ``up``."""
    n, bad, up = F.col("n"), F.col("bad"), F.col("up")
    chance = up * (1 - up)
    # One row of sums meets every row of the level.
    spread = rows.filter(n > 0).agg(
        F.sum(n * F.pow(bad / n - up, 2)).alias("seen"), F.sum(chance).alias("alone"), F.sum(chance * (n - 1)).alias("together"))
    rho = (F.col("seen") - F.col("alone")) / F.col("together")
    weight = F.when(F.col("together") > 0, F.least(F.lit(MOST), F.greatest(F.lit(LEAST), 1 / F.greatest(rho, F.lit(0.001)) - 1)))
    spread = spread.select(F.coalesce(weight, F.lit(LEAST)).alias("w"))
    return rows.crossJoin(F.broadcast(spread)).withColumn("a", up * F.col("w") + bad).withColumn("b", (1 - up) * F.col("w") + n - bad).drop("w", "up")


def reputation(labelled: DataFrame, public: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``host, a, b``: beta posterior of the bad share of every host of ``labelled`` (``host``, ``bad`` 1, 0 or null: unlabelled)."""
    suffix, domain = place(F.col("host"), public)
    hosts = labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    tops = domains.groupBy("suffix").agg(*sums)
    overall = tops.agg(F.coalesce(F.sum("bad") / F.sum("n"), F.lit(0.0)).alias("up"))  # null if nothing is labelled
    mean = (F.col("a") / (F.col("a") + F.col("b"))).alias("up")
    tops = _shrink(tops.crossJoin(F.broadcast(overall)))
    domains = _shrink(domains.join(tops.select("suffix", mean), "suffix"))
    return _shrink(hosts.join(domains.select("domain", mean), "domain")).select("host", "a", "b")


def blocked(z: float = Z, limit: float = LIMIT) -> Column:
    """Whether the lower bound of a posterior ``a, b`` is above the limit."""
    a, b = F.col("a"), F.col("b")
    return a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > limit


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, url: str = "url", z: float = Z, limit: float = LIMIT,
          public: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` (replacing columns of these names); pages that a rule judges are the labelled ones."""
    own = pages.select(F.col(url).alias("_url"), *(c for c in pages.columns if c not in ("host", "path", "rule", "verdict")))
    parsed = own.withColumn("host", split(F.col("_url"))[0]).withColumn("path", split(F.col("_url"))[1]).drop("_url")
    parsed = parsed.withColumn("_rule", best_rule(F.col("host"), F.col("path"), rules))
    hosts = reputation(parsed.select("host", (F.col("_rule.verdict") == "block").cast("int").alias("bad")), public)
    verdicts = hosts.select(F.col("host").alias("_host"), F.when(blocked(z, limit), "block").otherwise("allow").alias("_verdict"))
    joined = parsed.join(verdicts, parsed["host"] == verdicts["_host"], "left")
    return joined.withColumn("rule", F.col("_rule.rule")).withColumn("verdict", F.coalesce(F.col("_rule.verdict"), F.col("_verdict"))).drop("_rule", "_host", "_verdict")


def _sql_level(name: str, source: str, keys: str) -> str:
    return f"""
{name}_w AS (
  SELECT coalesce(CASE WHEN together > 0 THEN least(200.0::DOUBLE, greatest(2.0::DOUBLE, 1 / greatest((seen - alone) / together, 0.001::DOUBLE) - 1)) END, 2.0::DOUBLE) AS w
  FROM (SELECT sum(n * pow(bad::DOUBLE / n - up, 2)) AS seen, sum(up * (1 - up)) AS alone, sum(up * (1 - up) * (n - 1)) AS together FROM {source} WHERE n > 0)),
{name} AS (SELECT {keys}, up * w + bad AS a, (1 - up) * w + n - bad AS b FROM {source}, {name}_w)"""


SQL = f"""
WITH rules(name, start, rule, verdict) AS (VALUES ('com','/','com/','allow'), ('example.com','/en/','example.com/en/','block'),
  ('www.example.com','/en/','www.example.com/en/','allow'), ('net','/es/','net/es/','block'), ('net','/fr/','net/fr/','block')),
rests AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS rest FROM pages),
places AS (SELECT page_id, regexp_replace(rest, '(?s)[?#].*', '') AS place FROM rests),
parsed AS (
  SELECT page_id, translate(split_part(place, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(place, length(split_part(place, '/', 1)) + 1) AS path FROM places),
ruled AS (
  SELECT p.*, (SELECT r.rule FROM rules r WHERE (p.host = r.name OR ends_with(p.host, '.' || r.name)) AND starts_with(p.path, r.start)
    ORDER BY length(r.rule) DESC, length(r.name) DESC LIMIT 1) AS rule FROM parsed p),
judged AS (SELECT u.*, r.verdict AS given FROM ruled u LEFT JOIN rules r ON u.rule = r.rule),
hosts AS (
  SELECT host, array_to_string(list_slice(string_split(split_part(host, ':', 1), '.'), -2, -1), '.') AS domain, list_extract(string_split(split_part(host, ':', 1), '.'), -1) AS suffix,
    count(given) AS n, coalesce(sum((given = 'block')::INT), 0)::BIGINT AS bad FROM judged GROUP BY host),
domain_sums AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY domain, suffix),
top_sums AS (
  SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, coalesce((SELECT sum(bad)::DOUBLE / nullif(sum(n), 0) FROM domain_sums), 0) AS up
  FROM domain_sums GROUP BY suffix),{_sql_level("tops", "top_sums", "suffix")},
domain_rows AS (SELECT d.*, t.a / (t.a + t.b) AS up FROM domain_sums d JOIN tops t USING (suffix)),{_sql_level("domains", "domain_rows", "domain")},
host_rows AS (SELECT h.*, d.a / (d.a + d.b) AS up FROM hosts h JOIN domains d USING (domain)),{_sql_level("final", "host_rows", "host")}
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.given,
  CASE WHEN f.a / (f.a + f.b) - 1.645::DOUBLE * sqrt(f.a * f.b / ((f.a + f.b) * (f.a + f.b) * (f.a + f.b + 1))) > 0.5::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j JOIN final f USING (host)
"""
