"""URL filters: host and path rules first, a logistic regression for every other URL.

The model sees hashed character n-grams of the host and of the path. It is fitted on a small labelled URL
table that is built from the fixed words below; its weights become one SQL expression, so judging a table
of URLs is a projection without shuffle and without Python.

The labelled table holds no host of the tables that the model is used on. A null URL, or one without ``://``, has an empty host and path; the model then judges its bias alone. No
other column is read, repeated rows get equal verdicts, very long URLs are judged whole, and an empty table gives an empty table. Given columns
host, path, rule, verdict and score are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.shared import ascii_lower, table

#: (host, path prefix, verdict). A rule holds for the host and all its subdomains.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Fixed words of the labelled table: what unwanted hosts are about and what is put before and behind it, words of ordinary hosts, and syllables for names without a sense.
BAD_WORDS = (
    "casino", "poker", "slots", "jackpot", "betting", "sportsbet", "bets", "bookmaker", "lottery", "viagra", "pharmacy", "pills", "dietpills", "adult", "adultcam", "xxxtube", "porn", "hookup", "escort",
    "spam", "spammer", "phishing", "malware", "trojan", "warez", "keygen", "cracks", "torrent", "replica", "payday", "quickloan", "getrich", "doubler", "adserver", "adsclick", "tracker", "popunder", "clickbait", "linkfarm",
)
BAD_STARTS, BAD_ENDS = ("best-", "my-", "top", "buy-"), ("", "-bonus", "-deal", "-zone", "4u", "-hub", "-online", "-pro")
GOOD_WORDS = (
    "garden", "library", "history", "science", "recipes", "weather", "museum", "school", "university", "journal", "gazette", "council", "hospital", "railway", "theatre", "orchestra", "mountain", "harbour", "bakery", "cinema",
    "sports-club", "reading-room", "open-source", "docs", "forum", "notes", "maps", "archive", "kitchen", "travel-guide", "schule", "verein", "ecole", "mairie", "escuela", "radio", "village", "chess-club", "city-hall", "photo-blog",
)
SYLLABLES = ("ba", "le", "ri", "mo", "nu", "tha", "er", "en", "st", "ion", "ly", "or")
#: Hosts to measure the model on: none shares a word with the labelled table.
HELD_OUT = (
    *((h, 1.0) for h in ("roulette-vip", "blackjack-palace", "megabets", "freeslot-spins", "cialis-store", "cheappills", "nude-cams", "sexdating", "spamlink", "ad-tracking", "cracked-apps", "loans-fast", "fake-replicas", "clickads", "pornhubby")),
    *((h, 0.0) for h in ("carpentry", "geology-dept", "poetry-circle", "newspaper", "parliament", "astronomy", "cycling-tours", "pottery", "meteorology", "genealogy", "fire-brigade", "allotments", "zoology", "translation", "bookshop")),
)
PREFIXES, SUFFIXES = ("", "www.", "blog.", "m."), (".example.com", ".example.org", ".example.net", ".test")
PATHS = ("/en/421", "/de/17.html", "/fr/news/3", "/es/12/", "", "/en/88.html", "/fr/5", "/")
BAD_PATHS = ("/win/bonus", "/buy-now/deal", "/go/click?aff=1", "/free/spins")
#: N-gram lengths and hash slots of a feature vector; hosts and paths have slots of their own.
GRAMS, SLOTS = (3, 4), 4096
#: A URL is blocked above this probability.
THRESHOLD = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that holds, else null; of equally long ones the first in text order.

    The rules are one CASE expression: meant for lists up to a few hundred.
    """
    picked = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, prefix, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        holds = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        picked = F.when(holds, F.struct(F.lit(rule_host + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(picked)
    return picked


def gram_slots(host: Column, path: Column) -> Column:
    """Slots of all n-grams, one entry for each occurrence; digits are alike, as page numbers say nothing."""

    def slots(text: Column, n: int, part: int) -> Column:
        marked = F.concat(F.lit("^"), F.regexp_replace(text, "[0-9]+", "0"), F.lit("$"))
        starts = F.when(F.length(marked) >= n, F.sequence(F.lit(1), F.greatest(F.length(marked) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        slot = lambda i: F.pmod(F.xxhash64(F.substr(marked, i, F.lit(n))), F.lit(SLOTS // 2)) + part * (SLOTS // 2)
        return F.transform(starts, lambda i: slot(i).cast("int"))

    return F.concat(*[slots(text, n, part) for part, text in enumerate((host, path)) for n in GRAMS])


def named_urls(hosts: Sequence[tuple[str, float]]) -> list[tuple[str, float]]:
    """(url, label) of each host with every prefix, ends and paths in turn."""
    return [(f"https://{prefix}{word}{SUFFIXES[(i + j) % len(SUFFIXES)]}{PATHS[(i + 3 * j) % len(PATHS)]}", label) for i, (word, label) in enumerate(hosts) for j, prefix in enumerate(PREFIXES)]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The training table (url, label 1 for unwanted): unwanted words with some start or end, ordinary words, and names of three syllables."""
    names = [f"{a}{b}{c}" for i, a in enumerate(SYLLABLES) for j, b in enumerate(SYLLABLES) for k, c in enumerate(SYLLABLES) if (i + 5 * j + 7 * k) % 13 == 0]
    bad = [(word + BAD_ENDS[(i + 3 * j) % len(BAD_ENDS)], 1.0) for i, word in enumerate(BAD_WORDS) for j in range(2)]
    bad += [(BAD_STARTS[(i + j) % len(BAD_STARTS)] + word, 1.0) for i, word in enumerate(BAD_WORDS) for j in range(2)]
    rows = named_urls(bad) + named_urls([(x, 0.0) for x in (*GOOD_WORDS, *names)])
    for i, path in enumerate(BAD_PATHS):
        rows += [(f"http://{PREFIXES[j]}{GOOD_WORDS[i + 7 * j]}{SUFFIXES[j]}{path}", 1.0) for j in range(len(PREFIXES))]
    return spark.createDataFrame(rows, "url string, label double")


def fit(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights by slot and intercept. labelled(url, label) is a small table, some thousand rows at most."""
    host, path = host_and_path(F.col("url"))
    numbers = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    #: The slots are bound once as a lambda's argument; a plain column would be computed anew for each number.
    dense = F.transform(F.array(F.array_distinct(gram_slots(host, path))), lambda slots: F.transform(numbers, lambda i: F.array_contains(slots, i).cast("double")))[0]
    n = labelled.groupBy("label").count().collect()  # two rows: both labels weigh the same in sum
    weight = F.create_map(*[F.lit(x) for r in n for x in (r["label"], 1.0 / r["count"])])[F.col("label")]
    rows = labelled.select("label", array_to_vector(dense).alias("features"), weight.alias("weight")).coalesce(1)
    model = LogisticRegression(maxIter=100, regParam=0.002, standardization=False, weightCol="weight").fit(rows)
    return [float(x) for x in model.coefficients], float(model.intercept)


def unwanted(host: Column, path: Column, model: tuple[list[float], float]) -> Column:
    """The model's probability that the URL is unwanted."""
    weights, intercept = model
    table_of = F.lit([float(w) for w in weights])
    total = F.aggregate(F.array_distinct(gram_slots(host, path)), F.lit(intercept), lambda s, i: s + F.get(table_of, i))
    return 1 / (1 + F.exp(-total))


def judge_urls(pages: DataFrame, url: str = "url", rules=RULES, model: tuple[list[float], float] | None = None) -> DataFrame:
    """pages with columns host, path, rule, verdict and score (null where a rule decides); such columns are replaced."""
    model = model or fit(labelled_urls(pages.sparkSession))
    host, path = host_and_path(F.col(url))
    split = pages.withColumns({"host": host, "path": path})
    ruled = split.withColumn("__rule", rule_for(F.col("host"), F.col("path"), rules))
    scored = ruled.withColumn("score", F.when(F.col("__rule").isNull(), unwanted(F.col("host"), F.col("path"), model)))
    return scored.withColumns({
        "rule": F.col("__rule.rule"),
        "verdict": F.coalesce(F.col("__rule.verdict"), F.when(F.col("score") > THRESHOLD, "block").otherwise("allow")),
    }).drop("__rule")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")
