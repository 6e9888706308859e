"""URL filters: rules first, then naive Bayes on the words that host names are made of."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import scratch

#: Verdict, host and path of the rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Words that mark a host as unwanted for training; advertising, gambling, pharmacy, adult, fraud.
SEEDS = (
    "ads adserver adservice advert adverts popup popups clickbait tracker trackers "
    "casino casinos poker roulette slots jackpot lottery betting bets gambling bookmaker "
    "pills viagra cialis pharmacy meds steroids "
    "adult porn sex xxx nude escort escorts webcam hentai erotic fetish "
    "spam scam phishing malware warez torrent torrents crack cracked keygen hacked replica counterfeit payday"
).split()
_SEED_COUNT = 5  # times that each seed counts as seen by the segmenter
_SEED_ODDS = 8.0  # log odds of a seed, at least
_SMOOTH = 50.0  # words of the whole table's mix that each class is given beforehand
_HOSTS = 3  # hosts whose names share a label that is a word
_MEMORY = 200_000  # parts of names a worker holds at once
_RUN = r"[a-z]+|[0-9]+|[^\x00-\x7f]+"
_NUMBER = r"^[\p{Nd}\u00b2\u00b3\u00b9\u2070\u2074-\u2079\u2080-\u2089]+$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path of a url; both empty for null or without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule whose host or parent domain, and path start, fit; else null."""
    found = F.lit(None).cast("struct<rule string, verdict string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def split(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest split of a name into words by their frequency (Viterbi over unigrams); counts of its parts will do."""
    cost = {w: -math.log(n / total) for w, n in counts.items()}
    lengths = sorted({len(w) for w in cost})
    strange = math.log(total * 10)  # a word never seen; each letter costs more
    best, lead = [(0.0, 0)], (0.0, 0)  # lead: from where a word never seen costs least, whatever its length
    for end in range(1, len(name) + 1):
        options = [(best[lead[1]][0] + strange + 2.3 * (end - lead[1]), lead[1])]
        for length in lengths:
            if length > end:
                break
            known = cost.get(name[end - length : end])
            if known is not None:
                options.append((best[end - length][0] + known, end - length))
        best.append(min(options))
        lead = min(lead, (best[end][0] - 2.3 * end, end))
    words, end = [], len(name)
    while end:
        start = best[end][1]
        words.append(name[start:end])
        end = start
    return words[::-1]


def runs_of(name: Column) -> Column:
    """The runs of letters, digits and other signs in a name, with a blank between; a number is #."""
    found = F.regexp_extract_all(name, F.lit(_RUN), F.lit(0))
    return F.array_join(F.transform(found, lambda run: F.when(run.rlike(_NUMBER), "#").otherwise(run)), " ")


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, count): words of page titles, paths, hyphenated host labels and labels of several hosts, and the seeds."""
    title = F.lower(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    parts = F.filter(F.split("host", r"\."), lambda label: label.contains("-"))
    names = F.concat_ws(" ", title, F.lower("path"), F.array_join(parts, " "))
    words = pages.select(F.explode(F.split(names, r"[^a-z\x{80}-\x{10ffff}]+")).alias("word")).groupBy("word").count()
    labels = pages.select("host").distinct().select(F.explode(F.array_distinct(F.split("host", r"\."))).alias("word"))
    shared = labels.groupBy("word").count().filter(F.col("count") >= _HOSTS)
    found = words.union(shared).filter("word != ''").withColumn("least", F.lit(0))
    seeds = pages.sparkSession.createDataFrame([(w, 0, _SEED_COUNT) for w in SEEDS], "word string, count long, least int")
    both = found.union(seeds).groupBy("word").agg(F.sum("count").alias("count"), F.max("least").cast("long").alias("least"))
    return both.select("word", F.greatest("count", "least").alias("count"))


def _parts(lengths: list[int]):
    """Batches of (id, run) to (id, word): the parts of each run that are as long as some word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: set[tuple[bytes, str]] = set()
        for batch in batches:
            for key, name in zip(batch["id"], batch["run"]):
                for length in lengths:
                    if length > len(name):
                        break
                    for start in range(len(name) - length + 1):
                        found.add((key, name[start : start + length]))
                        if len(found) >= _MEMORY:
                            yield pd.DataFrame(list(found), columns=["id", "word"])
                            found = set()
        yield pd.DataFrame(list(found), columns=["id", "word"], dtype=object)

    return run


def segmented(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) of distinct ``run``; each gets the counts of its own parts, so no worker holds all words.

    Only parts as long as some counted word are looked up, whatever that length; they travel under a digest of their run.
    """
    total = counts.agg(F.sum("count")).first()[0] or 1
    lengths = sorted(r[0] for r in counts.select(F.length("word")).distinct().collect())  # a number for each length
    runs = runs.withColumn("id", F.unhex(F.md5("run")))
    hits = runs.select("id", "run").mapInPandas(_parts(lengths), "id binary, word string").join(counts, "word")
    known = hits.groupBy("id").agg(F.collect_list("word").alias("parts"), F.collect_list("count").alias("counts"))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def words(names: pd.Series, parts: pd.Series, numbers: pd.Series) -> pd.Series:
        found = [split(n, {} if p is None else dict(zip(p, c)), total) for n, p, c in zip(names, parts, numbers)]
        return pd.Series(found, dtype=object)

    return runs.join(known, "id", "left").select("run", words("run", "parts", "counts").alias("words"))


def _words(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(side, name, words) of distinct names (``runs_of`` hosts, side 0, and paths, side 1); words of paths start with /."""
    places = names.select("side", "name", F.posexplode(F.split("name", " ")).alias("at", "run"))
    runs = places.filter("run not in ('', '#')").select("run").distinct()
    found = scratch.stored(segmented(runs, counts))
    placed = places.join(found, "run", "left").withColumn("words", F.coalesce("words", F.filter(F.array("run"), lambda w: w != "")))
    lists = placed.groupBy("side", "name").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("lists"))
    words = F.flatten(F.col("lists.words"))
    return lists.select("side", "name", F.when(F.col("side") == 0, words).otherwise(F.transform(words, lambda w: F.concat(F.lit("/"), w))).alias("words"))


def scores(pages: DataFrame) -> tuple[DataFrame, float]:
    """(side, name, words, odds) of the distinct names of ``pages``, and the prior: naive Bayes, log odds of unwanted.

    Learned from all pages and all words; those whose host has a seed word are the unwanted ones.
    """
    counts = scratch.stored(word_counts(pages))
    pairs = scratch.stored(pages.groupBy("host_runs", "path_runs").count())
    names = pairs.select(F.explode(F.array(*(F.struct(F.lit(i).alias("side"), F.col(c).alias("name")) for i, c in enumerate(("host_runs", "path_runs"))))).alias("x"))
    words = scratch.stored(_words(names.select("x.*").distinct(), counts))
    bad = F.arrays_overlap("words", F.array(*map(F.lit, SEEDS))).alias("is_bad")
    hosts = words.filter("side = 0").select(F.col("name").alias("host_runs"), bad)
    n = [F.when(F.col("is_bad"), F.col("count")).otherwise(0), F.when(F.col("is_bad"), 0).otherwise(F.col("count"))]
    judged = pairs.join(hosts, "host_runs").select("host_runs", "path_runs", n[0].alias("bad"), n[1].alias("good"))
    sides = [judged.select(F.lit(i).alias("side"), F.col(c).alias("name"), "bad", "good") for i, c in enumerate(("host_runs", "path_runs"))]
    by_name = sides[0].union(sides[1]).groupBy("side", "name").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    by_name = scratch.stored(by_name)
    pages_bad, pages_good = (x or 0 for x in by_name.filter("side = 0").agg(F.sum("bad"), F.sum("good")).first())
    by_token = words.join(by_name, ["side", "name"]).select(F.explode("words").alias("token"), "bad", "good")
    by_token = scratch.stored(by_token.groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    all_bad, all_good = (x or 0 for x in by_token.agg(F.sum("bad"), F.sum("good")).first())
    usual = _SMOOTH * (F.col("bad") + F.col("good")) / F.lit(float(all_bad + all_good))
    found = F.log((F.col("bad") + usual) / (all_bad + _SMOOTH)) - F.log((F.col("good") + usual) / (all_good + _SMOOTH))
    odds = by_token.select("token", F.when(F.col("token").isin(*SEEDS), F.greatest(found, F.lit(_SEED_ODDS))).otherwise(found).alias("odds"))
    tokens = words.select("side", "name", F.posexplode("words").alias("at", "token")).join(odds, "token")
    lists = tokens.groupBy("side", "name").agg(F.array_sort(F.collect_list(F.struct("at", "odds"))).alias("lists"))  # in one order, so that sums repeat
    summed = lists.select("side", "name", F.aggregate("lists.odds", F.lit(0.0), lambda a, x: a + x).alias("odds"))
    named = words.join(summed, ["side", "name"], "left").select("side", "name", "words", F.coalesce("odds", F.lit(0.0)).alias("odds"))
    return scratch.stored(named), math.log((pages_bad + 1) / (pages_good + 2))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules=RULES) -> DataFrame:
    """(key, host, path, rule, verdict, words, score) for every row.

    The longest rule that fits decides; rule is then its text. Else rule is null and the classifier
    decides: block if the log odds of its words are above 0. A null url or one without
    :// has empty host and path, no words, and the verdict of the prior. Null html only
    lacks a title to learn words from. Repeated rows and null keys stay; other columns are not read; an empty
    table gives no rows. Learning sees all pages and all their words; distinct hosts and paths are scored once, only sums come to the driver.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    rows = rows.withColumns({"host_runs": runs_of(F.col("host")), "path_runs": runs_of(F.lower("path"))})
    named, prior = scores(rows)
    sides = [
        named.filter(F.col("side") == i).select(F.col("name").alias(c), F.col("words").alias(f"{c}_words"), F.col("odds").alias(f"{c}_odds"))
        for i, c in enumerate(("host_runs", "path_runs"))
    ]
    rule = rule_of(F.col("host"), F.col("path"), rules).alias("by")
    judged = rows.select("key", "host", "path", "host_runs", "path_runs", rule).join(sides[0], "host_runs", "left").join(sides[1], "path_runs", "left")
    score = F.lit(prior) + F.col("host_runs_odds") + F.col("path_runs_odds")
    verdict = F.coalesce("by.verdict", F.when(score > 0, "block").otherwise("allow"))
    words = F.concat("host_runs_words", "path_runs_words").alias("words")
    return judged.select(F.col("key").alias(key), "host", "path", "by.rule", verdict.alias("verdict"), words, score.alias("score"))
