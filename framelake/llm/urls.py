"""URL filters by empirical-Bayes host reputation (operator 5). DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import ascii_lower, checkpointed, lookup

#: verdict, host, start of the path
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Public suffixes of more than one label that are known without a table; any last label is one.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "com.cn")


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (host + path, null if none), and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def with_names(hosts: DataFrame, suffixes: DataFrame | Sequence[str] = SUFFIXES) -> DataFrame:
    """Adds domain (registered) and suffix (public) to hosts (host, unique).

    suffixes: rules of one to five labels in the notation of the public suffix list, plain, `*.x` and `!a.x`, as a list or a table with a column
    `suffix`; the longest that fits holds, an exception before all, and a last label without a rule is a suffix. What
    precedes an @, a port and a dot at the end are no part of the name. An IPv4 or bracketed IPv6 address, a name of one label and an empty one
    are their own domain and suffix, and a name that is a suffix is its own domain.
    """
    table = suffixes if isinstance(suffixes, DataFrame) else hosts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in suffixes])).alias("suffix"))
    table = table.select(F.col("suffix").alias("_rule")).filter("_rule IS NOT NULL").distinct()
    name = F.regexp_replace(F.regexp_extract("host", r"([^@]*)\z", 1), r"(?<![:\[])(?::[0-9]*)?\.?(?::[0-9]*)?\z", "")
    h = hosts.withColumn("_name", name).withColumn("_l", F.split("_name", r"\."))
    last = lambda n: F.array_join(F.slice("_l", F.greatest(F.lit(1), F.size("_l") - n + 1), n), ".")
    ways = [F.struct(F.lit(r).alias("r"), F.lit(k - r).alias("k"), F.when(F.size("_l") >= k, F.concat(F.lit(mark), last(k - cut))).alias("_rule")) for k in range(1, 6) for mark, cut, r in (("", 0, 0), ("*.", 1, 0), ("!", 0, 1)) if k > cut]
    fits = lookup(h.select("host", F.explode(F.array(*ways)).alias("_w")).select("host", "_w.*").filter("_rule IS NOT NULL"), table.withColumn("_is", F.lit(True)), "_rule").filter("_is")
    fits = fits.groupBy("host").agg(F.max(F.struct("r", "k")).alias("_f"))
    h = h.join(checkpointed(fits), "host", "left").withColumn("_k", F.coalesce("_f.k", F.lit(1)))
    alone = F.col("_name").rlike(r"\A(?:[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*\]|[^.]*)\z")
    named = {"domain": F.when(alone, F.col("_name")).otherwise(last(F.col("_k") + 1)), "suffix": F.when(alone, F.col("_name")).otherwise(last(F.col("_k")))}
    return h.withColumns(named).drop("_name", "_l", "_f", "_k")


def _log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series at x + 8."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(product)


def beta_below(a: Column, b: Column, x: float) -> Column:
    """Probability that a Beta(a, b) value is x or less: the regularised incomplete beta function.

    The continued fraction for it, evaluated from the front with as many terms as the size of a and b asks for, on the side of the mean where it converges.
    """
    swap = F.lit(x) > (a + 1) / (a + b + 2)
    p, q, z = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b), F.when(swap, 1 - x).otherwise(x)
    given = F.struct(p.alias("p"), q.alias("q"), z.alias("z"))
    away = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)

    def term(s: Column, odd: bool, i: Column) -> Column:
        p, q, z, m = s["p"], s["q"], s["z"], i.cast("double")
        return -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)) if odd else m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))

    def step(s: Column, t: Column) -> Column:
        d, c = 1 / away(1 + t * s["d"]), away(1 + t / s["c"])
        return F.struct(s["p"].alias("p"), s["q"].alias("q"), s["z"].alias("z"), d.alias("d"), c.alias("c"), (s["f"] * d * c).alias("f"))

    first = F.transform(F.array(given), lambda g: F.struct(g["p"].alias("p"), g["q"].alias("q"), g["z"].alias("z"), F.lit(0.0).alias("d"), F.lit(1.0).alias("c"), F.lit(1.0).alias("f")))[0]
    # terms of the fraction 1 + t1 / (1 + t2 / ...): odd ones from 0, even ones from 1
    terms = F.sequence(F.lit(1), F.ceil(60 + 10 * F.sqrt(F.greatest(a, b))).cast("int"))
    done = F.aggregate(terms, first, lambda s, i: step(s, F.when(i % 2 == 1, term(s, True, F.floor(i / 2))).otherwise(term(s, False, F.floor(i / 2)))), lambda s: s["f"])
    front = F.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + p * F.log(z) + q * F.log(1 - z)) / p
    return F.when(swap, 1 - front / done).otherwise(front / done)


def _strength(children: DataFrame, own: str, parent: str) -> float:
    """Prior strength of a level, one number: a + b of the beta that the children's rates have around their parent's.

    By moments: the variance of the rates beyond what binomial draws have gives the strength; within 1 to 1000, and 1000
    where the rates vary no more than chance does.
    """
    p, n = F.col(parent), F.col(f"{own}_n")
    rate = F.col(f"{own}_bad") / n
    s = children.agg(F.sum(n * (rate - p) * (rate - p)).alias("_ss"), F.sum(p * (1 - p)).alias("_pq"), F.sum(n * p * (1 - p)).alias("_npq"))
    # E[n (rate - p)^2] = p q (1 + (n - 1) / (strength + 1))
    over = (F.col("_ss") - F.col("_pq")) / F.nullif(F.col("_npq") - F.col("_pq"), F.lit(0.0))
    return s.select(F.coalesce(F.when(over <= 0.001, 1000.0).otherwise(F.greatest(F.lit(1.0), 1 / over - 1)), F.lit(1000.0))).first()[0]


def host_reputation(hosts: DataFrame, limit: float = 0.5, suffixes: DataFrame | Sequence[str] = SUFFIXES) -> DataFrame:
    """host, n, bad, mean and below of hosts (host, n, bad: labelled pages and bad ones among them).

    A suffix's rate is shrunk to that of all pages, a domain's to its suffix's, a host's to its domain's: the posterior of a
    beta-binomial, whose mean is (bad + strength * parent) / (n + strength). below is the posterior probability that the rate is `limit` or less.
    A host without labels has its domain's posterior. All levels are aggregates; none needs a row per page.
    """
    h = checkpointed(with_names(hosts, suffixes))
    every = h.agg((F.sum("bad") + 1.0) / (F.sum("n") + 2.0)).first()[0]
    every = F.lit(0.5 if every is None else every)

    def level(rows: DataFrame, name: str, prior: str, out: str) -> DataFrame:
        k = F.lit(_strength(rows.filter(f"{name}_n > 0"), name, prior))
        return rows.withColumns({f"{name}_k": k, out: (F.col(f"{name}_bad") + k * F.col(prior)) / (F.col(f"{name}_n") + k)})

    sums = lambda by, name: h.groupBy(*by).agg(F.sum("n").alias(f"{name}_n"), F.sum("bad").alias(f"{name}_bad"), F.count("*").alias("_c"))
    total = h.count()
    s = checkpointed(level(sums(["suffix"], "suffix").withColumn("p0", every), "suffix", "p0", "p1"))
    d = sums(["domain", "suffix"], "domain").withColumnRenamed("_c", "_d")
    d = checkpointed(lookup(checkpointed(d), s.select("suffix", "p1", "_c"), "suffix", "_c", total).drop("_c"))
    d = checkpointed(level(d, "domain", "p1", "p2"))
    r = lookup(h.withColumnsRenamed({"n": "host_n", "bad": "host_bad"}), d.select("domain", "p2", "_d"), "domain", "_d", total)
    r = level(checkpointed(r), "host", "p2", "mean")
    m = F.col("host_n") + F.col("host_k")
    return r.select("host", F.col("host_n").alias("n"), F.col("host_bad").alias("bad"), "mean", beta_below(F.col("mean") * m, (1 - F.col("mean")) * m, limit).alias("below"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, limit: float = 0.5, doubt: float = 0.05, page_id: str = "page_id", url: str = "url", suffixes: DataFrame | Sequence[str] = SUFFIXES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, bad_rate, good_chance.

    outcomes: page_id, bad (boolean): labelled pages. A page is blocked if the lower bound of its host's bad rate, the `doubt` quantile of the
    posterior, is over `limit`; that is, if good_chance, the posterior probability that the rate is no more than `limit`, is less than `doubt`.
    A rule that fits goes before that, the longest first. Null urls and those without :// have empty host and path, are one
    host with an empty name, and fit no rule. Null or repeated labels: nulls don't count, a page with several is bad if one says so.
    Without any labels nothing is blocked but by rules. Repeated pages give a row each; an empty table gives none.
    """
    p = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    p = checkpointed(p)
    known = outcomes.filter("bad IS NOT NULL AND page_id IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("_bad"))
    per = p.join(known, "page_id", "left").groupBy("host").agg(F.count("_bad").alias("n"), F.coalesce(F.sum(F.col("_bad").cast("long")), F.lit(0)).alias("bad"), F.count("*").alias("_rows"))
    per = checkpointed(per)
    rep = host_reputation(per.drop("_rows"), limit, suffixes).join(per.select("host", "_rows"), "host")
    out = lookup(p, checkpointed(rep.select("host", "_rows", "mean", "below")), "host", "_rows", p.count())
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("below") < doubt, "block").otherwise("allow")
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("mean").alias("bad_rate"), F.col("below").alias("good_chance"))


def labelled_pages(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, bad: outcomes of pages from labels (doc_id, toxic, quality) of the documents that they show.

    A page shows the document whose number its path ends with (`/en/17` shows 17). A document is bad if it is toxic or of low quality.
    """
    shown = F.regexp_extract(url_path(F.col(url)), r"/([0-9]{1,18})\z", 1)
    p = pages.select(F.col(page_id).alias("page_id"), F.nullif(shown, F.lit("")).cast("long").alias("doc_id")).filter("doc_id IS NOT NULL")
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    known = checkpointed(labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(bad).alias("bad")))
    often = checkpointed(known.join(p.groupBy("doc_id").agg(F.count("*").alias("_n")), "doc_id"))  # of what is shown
    total = often.agg(F.sum("_n")).first()[0] or 0
    return lookup(p, often, "doc_id", "_n", total).filter("bad IS NOT NULL").select("page_id", "bad")
