"""URL filters: host and path rules, then logistic regression on hashed character n-grams.

All of it is DataFrame functions.  The regression learns from a small labelled table of URLs in one query: the table
becomes one row of two arrays (the slots of each url, the urls of each slot), and gradient steps fold over them.  Only
the weights, a fixed number of slots, pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.workspace import table

SLOTS, STEPS, RATE, SHRINK = 4096, 30, 0.5, 1e-5
#: urls of the labelled table that are learned from at most; the bound of a table given by the caller
MOST_LABELLED = 5000
#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

# The labelled table is made by rule.  Unwanted hosts join a word of one of the usual categories of public blocklists
# (gambling, adult, drugs, fraud, advertising, spam, malware) with a filler; ordinary hosts join an everyday word, or a
# name spelled from syllables, with the same fillers, so that fillers teach nothing.
UNWANTED = """casino poker betting bets roulette jackpot lottery blackjack bingo wager
porn adult xxx sex escort nude erotic webcam
pills viagra pharmacy steroids cialis drugs
phishing replica payday scam fraud prize
ads adserver banner popup tracker clicks affiliate
spam backlinks linkfarm clickbait
malware warez crack keygen torrent virus""".split()
EVERYDAY = """news times herald science nature library museum garden cooking travel math history data code weather
train school music film health council sport chess star bird language law poem energy water bridge island
mountain winter river forest kitchen family street market city radio photo paint letter paper history theatre
nation station thread shelter thermal brother feather north south earth order thing""".split()
FILLERS = "best online top world king zone hub club win free cheap deals shop live easy x".split()


def _names(n: int) -> list[str]:
    """``n`` made-up names of two or three syllables."""
    first, last = "ba co di fe go ha ji ku la mo ne pi ra se th ti un ve wh yo".split(), "n r s nd st ed er on es in".split()
    return [first[i % 20] + first[(7 * i + i // 20) % 20] * (i % 3 > 0) + "aeiou"[i % 5] + last[(3 * i + i // 11) % 10] for i in range(n)]


def labelled_rows() -> list[tuple[str, int]]:
    """(url, label 0 or 1) by rule: each name alone or with fillers, below several domains and paths."""
    rows = []
    for label, names, times in ((1, UNWANTED, 8), (0, EVERYDAY + _names(160), 3)):
        for i, name in enumerate(names):
            for j in range(times):
                k = 31 * i + 7 * j
                filler = FILLERS[k % len(FILLERS)]
                host = (f"{name}-{filler}", f"{filler}-{name}", name, f"{name}{filler}")[(i + j) % 4]
                front, domain = ("", "www.", "blog.", "m.")[k % 4], ("example.com", "example.net", "example.org")[k % 3]
                path = ("/", "/en/12", "/fr/345/", "/de/6.html", "/es/78")[k % 5]
                rows.append((f"https://{front}{host}.{domain}{path}", label))
    return rows


def training_table(spark: SparkSession, held_out: bool | None = None) -> DataFrame:
    """(url, label) of the table; held_out picks the fold of urls (crc32 mod 4 = 0), or the rest."""
    listed = ", ".join(f"('{u}', {y}D)" for u, y in labelled_rows())
    rows = spark.sql(f"SELECT url, label, crc32(encode(url, 'UTF-8')) % 4 = 0 AS held FROM VALUES {listed} AS t(url, label)")
    return (rows if held_out is None else rows.where(F.col("held") == held_out)).select("url", "label")


def _parts(url: str) -> tuple[Column, Column]:
    text = F.coalesce(F.col(url), F.lit(""))
    host = F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _slots(host: str, path: str) -> Column:
    """Slots of the 3-, 4- and 5-grams of the framed host and of the path's words, repeats included, and the bias slot."""
    s = f"concat('^', {host}, '$', regexp_replace({path}, '[0-9]+', '0'), ' ')"
    grams = [f"transform(sequence(0, greatest(size(c) - {n}, 0)), i -> cast(pmod(xxhash64({', '.join(f'get(c, i + {j})' for j in range(n))}), {SLOTS}) AS int))" for n in (3, 4, 5)]
    # the characters as an array: a substring would be sought from the start each time
    return F.expr(f"concat(flatten(transform(array(split({s}, '')), c -> concat({', '.join(grams)}))), array({SLOTS}))")


def _probability(slots: str, weights: str) -> str:
    return f"1 / (1 + exp(-aggregate({slots}, 0D, (a, h) -> a + ({weights})[h]) / sqrt(size({slots}))))"


def train(labelled: DataFrame, steps: int = STEPS) -> list[float]:
    """Weights of the slots and of the bias (last) after ``steps`` full gradient steps, as one query; a slot's step
    shrinks with the slopes it has met.

    Of ``labelled`` (url, label) the ``MOST_LABELLED`` rows with the smallest hashes are learned from.  Null labels teach
    nothing; an empty table gives zeros.
    """
    host, path = _parts("url")
    rows = labelled.where("label is not null").orderBy(F.xxhash64("url", "label"), "url", "label").limit(MOST_LABELLED)
    rows = rows.select("label", host.alias("host"), path.alias("path")).select("label", _slots("host", "path").alias("slots"))
    table = rows.agg(F.array_sort(F.collect_list(F.struct("slots", F.col("label").cast("double").alias("label")))).alias("rows"))
    entries = table.select(F.posexplode("rows").alias("at", "row")).select("at", F.explode("row.slots").alias("slot"), (1 / F.sqrt(F.size("row.slots"))).alias("v"))
    summed = entries.groupBy("slot", "at").agg(F.sum("v").alias("v")).groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("urls"))
    every = labelled.sparkSession.range(SLOTS + 1).select(F.col("id").cast("int").alias("slot")).join(F.broadcast(summed), "slot", "left")
    lists = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "urls"))), lambda x: x["urls"]).alias("lists"))
    gaps = f"transform(rows, r -> ({_probability('r.slots', 'state.w')} - r.label) / greatest(size(rows), 1))"
    slopes = f"transform(array({gaps}), g -> transform(state.w, (old, s) -> {SHRINK} * old + aggregate(coalesce(lists[s], array()), 0D, (a, e) -> a + g[e.at] * e.v)))[0]"
    speed = "zip_with(state.speed, d, (u, x) -> u + x * x)"
    moved = f"transform(d, (x, s) -> state.w[s] - {RATE} * x / sqrt(state.speed[s] + x * x))"
    step = f"transform(array({slopes}), d -> named_struct('w', {moved}, 'speed', {speed}))[0]"
    start = f"named_struct('w', array_repeat(0D, {SLOTS + 1}), 'speed', array_repeat(1e-12D, {SLOTS + 1}))"
    learned = table.crossJoin(lists).select(F.expr(f"aggregate(sequence(1, {steps}), {start}, (state, t) -> {step}).w").alias("w"))  # one row by one row
    return list(learned.first()["w"])


def _score(slots: str, weights: list[float]) -> Column:
    listed = ",".join(f"{w:.8g}" for w in weights)
    return F.expr(_probability(slots, f"cast(split('{listed}', ',') AS array<double>)"))


def url_filter(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict, score.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest wins.  Other urls are
    blocked from a score (the probability of block) of one half.  Null urls and urls without :// have an empty host and
    path, fit no rule and are scored as such.  Rows are judged each, repeated ones alike; an empty table has no rows;
    other columns are ignored.  Urls of any length are read whole.
    """
    weights = train(labelled if labelled is not None else training_table(pages.sparkSession))
    host, path = _parts("url")
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    scored = parts.select("*", _slots("host", "path").alias("slots"))
    scored = scored.select("page_id", "host", "path", (rule if rule is not None else F.lit(None).cast("string")).alias("rule"), (verdict if verdict is not None else F.lit(None).cast("string")).alias("ruled"), _score("slots", weights).alias("score"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def query(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages"))
