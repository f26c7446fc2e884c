"""URL filters: block and allow rules, and a character language-model ratio for the urls that no rule fits.

Two smoothed variable-order Markov models of characters, one of accepted and one of rejected urls,
are learned from the urls that the rules decide. A character's probability after up to two
characters before it is mixed down the orders (Witten-Bell): the longer context counts as much as its
occurrences against its different followers, the rest goes to the shorter one, and at last to an even
choice of the alphabet. A url's score is the difference of the two log-likelihoods over its length;
the threshold is the score that parts best the urls of a fold kept out of the counts.

All of it is DataFrame operations. Characters are mapped to an alphabet of at most ALPHABET signs, so a
model has at most ALPHABET ** 3 rows whatever the urls: that bounds what is broadcast.

Defined results: a null url, or one without '://', has empty host and path and is judged by the model
as an empty string, which scores zero; repeated urls get equal verdicts; other columns are ignored.
With no urls of both kinds decided by rules, the model allows everything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Signs that a url's characters become: letters, and these; digits are one sign, and so is all else.
SIGNS = "abcdefghijklmnopqrstuvwxyz./-_?=&#%:"
ALPHABET = len(SIGNS) + 3  # with the digit, the other and the edge
START, DIGIT, OTHER = "^", "0", "~"
#: The fold that the threshold is chosen on: urls whose MD5 begins so.
HELD_OUT = ("0", "1", "2")
#: Steps of the score among which the threshold is chosen.
STEP = 0.01


@dataclass(frozen=True)
class Rule:
    kind: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of this query.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(1 << 30))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def matched(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """(rule, kind) of the longest rule that fits, else null. Of two of one length the first listed wins."""
    fitting = F.lit(None).cast("struct<rule:string,kind:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        fitting = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"))).otherwise(fitting)
    return fitting


def signs(url: Column) -> Column:
    """The url in signs, after two edges."""
    low = ascii_lower(F.coalesce(url, F.lit("")))
    low = F.regexp_replace(low, r"[0-9]", DIGIT)
    low = F.regexp_replace(low, "[^a-z0./_?=&#%:-]", OTHER)
    return F.when(F.length(low) > 0, F.concat(F.lit(START * 2), low)).otherwise(F.lit(""))


def grams(rows: DataFrame) -> DataFrame:
    """One row for each sign with the two before it (column g). The signs are parted once, so a long url takes time in proportion."""
    apart = F.split("signs", "")
    n = F.greatest(F.size(apart) - 2, F.lit(0))
    three = F.arrays_zip(F.slice(apart, 1, n).alias("a"), F.slice(apart, 2, n).alias("b"), F.slice(apart, 3, n).alias("c"))
    zipped = rows.withColumn("g", F.explode(F.when(F.length("signs") > 2, three)))
    return zipped.withColumn("g", F.concat("g.a", "g.b", "g.c")).drop("signs")


def model(urls: DataFrame) -> DataFrame:
    """g, ratio: log P(accepted model) - log P(rejected model) of g's last sign after the two before, for each g of either.

    urls: signs and kind (allow or block), each row counted.
    """
    counted = grams(urls.filter("kind is not null").select("kind", "signs")).groupBy("kind", "g").agg(F.count("*").cast("double").alias("n"))
    counted = counted.select("kind", "g", "n", F.substring("g", 2, 2).alias("g2"), F.substring("g", 3, 1).alias("g1"))
    kinds = []
    even = F.lit(1.0 / ALPHABET)
    for kind in ("allow", "block"):
        c3 = counted.filter(F.col("kind") == kind)
        h3 = c3.groupBy(F.substring("g", 1, 2).alias("h2")).agg(F.sum("n").alias("h2_n"), F.count("*").alias("h2_t"))
        c2 = c3.groupBy("g2").agg(F.sum("n").alias("n2"))
        h2 = c2.groupBy(F.substring("g2", 1, 1).alias("h1")).agg(F.sum("n2").alias("h1_n"), F.count("*").alias("h1_t"))
        c1 = c3.groupBy("g1").agg(F.sum("n").alias("n1"))
        h1 = c1.agg(F.coalesce(F.sum("n1"), F.lit(0.0)).alias("all_n"), F.count("*").alias("all_t")).withColumn("one", F.lit(1))
        every = counted.select("g", "g2", "g1").distinct().withColumn("h2", F.substring("g", 1, 2)).withColumn("h1", F.substring("g2", 1, 1)).withColumn("one", F.lit(1))
        own = (
            every.join(c3.select("g", "n"), "g", "left").join(h3, "h2", "left").join(c2, "g2", "left").join(h2, "h1", "left").join(c1, "g1", "left").join(h1, "one", "left")
            .na.fill(0.0, ["n", "h2_n", "n2", "h1_n", "n1", "all_n"]).na.fill(0, ["h2_t", "h1_t", "all_t"])
        )
        p1 = (F.col("n1") + F.greatest(F.col("all_t"), F.lit(1)) * even) / (F.col("all_n") + F.greatest(F.col("all_t"), F.lit(1)))
        p2 = F.when(F.col("h1_n") > 0, (F.col("n2") + F.col("h1_t") * p1) / (F.col("h1_n") + F.col("h1_t"))).otherwise(p1)
        p3 = F.when(F.col("h2_n") > 0, (F.col("n") + F.col("h2_t") * p2) / (F.col("h2_n") + F.col("h2_t"))).otherwise(p2)
        kinds.append(own.select("g", F.log(p3).alias(kind)))
    return kinds[0].join(kinds[1], "g").select("g", (F.col("allow") - F.col("block")).alias("ratio"))


def scores(rows: DataFrame, ratios: DataFrame, key: str) -> DataFrame:
    """key and score: mean ratio over the signs; a sign in a context that neither model knows is no evidence."""
    seen = grams(rows.select(key, "signs")).join(F.broadcast(ratios), "g", "left")
    return seen.groupBy(key).agg(F.sum(F.coalesce("ratio", F.lit(0.0)).cast("decimal(38,9)")).cast("double").alias("total"), F.count("*").alias("n")).select(key, (F.col("total") / F.col("n")).alias("score"))


def threshold(held: DataFrame) -> float:
    """The score from which to allow that errs least on the held-out urls, both kinds weighing the same; among equals, midway."""
    bins = held.groupBy(F.floor(F.col("score") / STEP).cast("long").alias("bin")).agg(F.count_if(F.col("kind") == "allow").alias("good"), F.count_if(F.col("kind") == "block").alias("bad")).orderBy("bin").collect()
    good, bad = sum(r["good"] for r in bins), sum(r["bad"] for r in bins)
    if not good or not bad:
        return float("-inf")
    lost, kept, best = 0, bad, []
    for i, r in enumerate(bins):
        best.append((lost / good + kept / bad, r["bin"], bins[i - 1]["bin"] + 1 if i else r["bin"]))
        lost, kept = lost + r["good"], kept - r["bad"]
    least = min(b[0] for b in best)
    run = next((a, b) for e, b, a in best if e == least)
    return STEP * (run[0] + run[1]) / 2


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("m", matched(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "url", "host", "path", "m.rule", "m.kind")
    # Each different url is scored once, however many pages have it; its signs are counted under its MD5, since a row for each sign must not carry a long url.
    different = rows.groupBy("url").agg(F.max("kind").alias("kind")).withColumn("signs", signs(F.col("url"))).withColumn("id", F.md5("url"))
    different = different.drop("url").withColumn("held", F.substring("id", 1, 1).isin(*HELD_OUT))
    ratios = cut(model(different.filter("not held")))
    held = scores(different.filter("held and kind is not null").withColumn("key", F.struct("id", "kind")), ratios, "key")
    least = threshold(held.select("score", "key.kind"))
    # A url with a rule needs no score for its verdict.
    judged = scores(different.filter("kind is null and id is not null"), ratios, "id")
    allowed = F.coalesce(F.col("score"), F.lit(0.0)) >= least
    verdict = F.coalesce(F.col("kind"), F.when(allowed, "allow").otherwise("block"))
    return rows.withColumn("id", F.md5("url")).join(judged, "id", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same verdicts in SQL, without the score, whose last digits depend on the engine's logarithm."""
    listed = ", ".join(f"('{r.kind}', '{r.host}', '{r.path}')" for r in rules)
    held = ", ".join(f"'{x}'" for x in HELD_OUT)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH rules(kind, host, path) AS (VALUES {listed}),
rest AS (SELECT page_id, url, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS rest FROM pages),
parts AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
places AS (SELECT DISTINCT host, path FROM parts),
fits AS (SELECT p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.kind, length(r.host || r.path)) AS kind
  FROM places p JOIN rules r ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY ALL),
ruled AS (SELECT page_id, url, parts.host, parts.path, rule, kind FROM parts LEFT JOIN fits ON parts.host = fits.host AND parts.path = fits.path),
plain AS (SELECT url, max(kind) AS kind, regexp_replace(regexp_replace(translate(coalesce(url, ''), '{upper}', '{lower}'), '[0-9]', '0', 'g'), '[^a-z0./_?=&#%:-]', '~', 'g') AS low FROM ruled GROUP BY url),
different AS (SELECT url, kind, CASE WHEN low = '' THEN '' ELSE '^^' || low END AS signs, substr(md5(url), 1, 1) IN ({held}) AS held FROM plain),
grams AS (SELECT url, kind, held, substr(signs, i::BIGINT, 3) AS g FROM different, LATERAL (SELECT unnest(range(1, length(signs) - 1)) AS i)),
c3 AS (SELECT kind, g, count(*)::DOUBLE AS n FROM grams WHERE kind IS NOT NULL AND NOT held GROUP BY ALL),
h3 AS (SELECT kind, substr(g, 1, 2) AS h, sum(n) AS n, count(*) AS t FROM c3 GROUP BY ALL),
c2 AS (SELECT kind, substr(g, 2, 2) AS g, sum(n) AS n FROM c3 GROUP BY ALL),
h2 AS (SELECT kind, substr(g, 1, 1) AS h, sum(n) AS n, count(*) AS t FROM c2 GROUP BY ALL),
c1 AS (SELECT kind, substr(g, 3, 1) AS g, sum(n) AS n FROM c3 GROUP BY ALL),
h1 AS (SELECT kind, sum(n) AS n, count(*) AS t FROM c1 GROUP BY ALL),
kinds(kind) AS (VALUES ('allow'), ('block')),
known AS (SELECT kinds.kind, every.g FROM kinds, (SELECT DISTINCT g FROM c3) every),
joined AS (SELECT k.kind, k.g, coalesce(c3.n, 0) AS n3, coalesce(h3.n, 0) AS h3n, coalesce(h3.t, 0) AS h3t, coalesce(c2.n, 0) AS n2, coalesce(h2.n, 0) AS h2n, coalesce(h2.t, 0) AS h2t, coalesce(c1.n, 0) AS n1, coalesce(h1.n, 0) AS h1n, greatest(coalesce(h1.t, 0), 1) AS h1t
  FROM known k LEFT JOIN c3 ON c3.kind = k.kind AND c3.g = k.g LEFT JOIN h3 ON h3.kind = k.kind AND h3.h = substr(k.g, 1, 2) LEFT JOIN c2 ON c2.kind = k.kind AND c2.g = substr(k.g, 2, 2)
  LEFT JOIN h2 ON h2.kind = k.kind AND h2.h = substr(k.g, 2, 1) LEFT JOIN c1 ON c1.kind = k.kind AND c1.g = substr(k.g, 3, 1) LEFT JOIN h1 ON h1.kind = k.kind),
one AS (SELECT *, (n1 + h1t * (1.0::DOUBLE / {ALPHABET})) / (h1n + h1t) AS p1 FROM joined),
two AS (SELECT *, CASE WHEN h2n > 0 THEN (n2 + h2t * p1) / (h2n + h2t) ELSE p1 END AS p2 FROM one),
three AS (SELECT kind, g, ln(CASE WHEN h3n > 0 THEN (n3 + h3t * p2) / (h3n + h3t) ELSE p2 END) AS l FROM two),
ratios AS (SELECT a.g, CAST(a.l - b.l AS DECIMAL(38, 9)) AS ratio FROM three a JOIN three b ON a.g = b.g AND a.kind = 'allow' AND b.kind = 'block'),
scored AS (SELECT url, kind, held, sum(coalesce(ratio, 0))::DOUBLE / count(*) AS score FROM grams LEFT JOIN ratios ON grams.g = ratios.g GROUP BY url, kind, held),
bins AS (SELECT floor(score / {STEP}::DOUBLE)::BIGINT AS bin, count(*) FILTER (kind = 'allow') AS good, count(*) FILTER (kind = 'block') AS bad FROM scored WHERE held AND kind IS NOT NULL GROUP BY 1),
sums AS (SELECT bin, lag(bin) OVER w AS before, sum(good) OVER () AS all_good, sum(bad) OVER () AS all_bad, sum(good) OVER w - good AS lost, sum(bad) OVER () - sum(bad) OVER w + bad AS kept FROM bins WINDOW w AS (ORDER BY bin)),
least AS (SELECT {STEP}::DOUBLE * (bin + coalesce(before + 1, bin)) / 2 AS least FROM sums WHERE all_good > 0 AND all_bad > 0 ORDER BY lost::DOUBLE / all_good::DOUBLE + kept::DOUBLE / all_bad::DOUBLE, bin LIMIT 1)
SELECT page_id, host, path, rule, coalesce(r.kind, CASE WHEN coalesce(s.score, 0) >= coalesce((SELECT least FROM least), '-infinity'::DOUBLE) THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled r LEFT JOIN scored s ON r.url = s.url"""
