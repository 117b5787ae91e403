"""Quality rules: base counts, and robust multivariate outliers per language and source.

Everything is DataFrame functions.  Each text becomes a row of counts; transformed shares of them are the vectors.  For
every (language, source) the minimum-covariance-determinant estimate is sought from three deterministic starts: medians
with median deviations, the covariance of squashed scores, and that of spatial signs.  Concentration steps follow: the
three quarters of the rows nearest by Mahalanobis distance give the next mean and covariance, until no determinant moves;
of the starts the estimate with the smallest determinant is taken.  A vector too far from it is rejected.  Groups of few
rows use their language's estimate.

Medians and nearest rows come from histograms, so no order of merging changes a verdict.  A step is one pass: moments are
added up by group, start and distance bucket, a partial aggregate whose size depends on groups alone, so a source with a
third of all rows is no task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.workspace import Workspace, few, lookup, table

DIMS = ("x0", "x1", "x2", "x3", "x4")
#: share of rows nearest to an estimate, most concentration steps, and the change of a log determinant that ends them
SUBSET, STEPS, STILL = 0.75, 10, 1e-6
#: buckets of a unit of a vector, for medians, and of a doubling of the distance
FINE, OCTAVE = 512, 16
#: a share's standard deviation that is never told apart from noise, on the logarithmic scale of the vectors
FLOOR = 0.4
# fixed values: consistency factor of the covariance of the nearest 0.75, and the chi-square quantile 1 - 1e-5, both for 5 dimensions
CONSISTENCY, CUTOFF = 1.412, 30.86
_SPACE = r"[\x20\x09-\x0D]"


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every text; null texts have no words."""
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *((F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    worded = base.select(
        "doc_id", "lang", "source",
        F.array_remove(F.split("text", f"{_SPACE}+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}", ""))).cast("long").alias("n_upper"),
    )
    # windows as 33 bits of hash above 31 bits of position: a primitive sort brings equal hashes together
    counted = worded.select(
        "doc_id", "lang", "source", "words", "n_symbols", "n_upper",
        F.size("words").cast("long").alias("n_words"), F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("""CASE WHEN size(words) < 3 THEN cast(array() AS array<bigint>) ELSE sort_array(transform(sequence(0, size(words) - 3),
                  i -> (shiftleft(xxhash64(words[i], words[i + 1], words[i + 2]), 31) | cast(i AS bigint)))) END""").alias("packed"),
    )
    near = counted.select(
        "*", F.expr("""transform(filter(packed, (x, k) -> (k > 0 AND shiftright(packed[greatest(k - 1, 0)], 31) = shiftright(x, 31))
                                       OR (k < size(packed) - 1 AND shiftright(packed[least(k + 1, size(packed) - 1)], 31) = shiftright(x, 31))),
                         x -> cast(x & 2147483647L AS int))""").alias("near"))
    exact = near.select(
        "*", F.expr("CASE WHEN size(near) = 0 THEN NULL ELSE array_sort(transform(near, i -> struct(words[i] AS a, words[i + 1] AS b, words[i + 2] AS c, i AS i))) END").alias("sorted"))
    same = "(sorted[{0}].a = w.a AND sorted[{0}].b = w.b AND sorted[{0}].c = w.c)"
    repeated = exact.select(
        "*", F.expr(f"""sort_array(transform(filter(sorted, (w, k) -> (k > 0 AND {same.format('greatest(k - 1, 0)')})
                                                     OR (k < size(sorted) - 1 AND {same.format('least(k + 1, size(sorted) - 1)')})), w -> w.i))""").alias("at"))
    covered = F.expr("aggregate(at, struct(-3 AS last, 0L AS n), (s, i) -> struct(i AS last, s.n + least(3, i - s.last) AS n), s -> s.n)")
    return repeated.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _vectors(stats: DataFrame) -> DataFrame:
    share = lambda a, b: F.log1p(F.lit(100.0) * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    xs = (F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), share("n_symbols", "word_chars"), share("n_upper", "word_chars"), share("n_dup_lines", "n_words"), 3 * F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)))
    return stats.select("*", *(x.alias(d) for x, d in zip(xs, DIMS, strict=True)))


_P = range(len(DIMS))
_PAIRS = [(i, j) for i in _P for j in range(i + 1)]


def _factor(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Means, the log determinant, and W, the inverse of the covariance's Cholesky factor, one named column an entry."""
    named = {}  # each expression refers to those before it
    for i, j in _PAIRS:
        rest = f"coalesce(c{i}{j}, 0D) * {CONSISTENCY}D" + (f" + {FLOOR**2}D" if i == j else "") + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        named[f"l{i}{j}"] = f"sqrt(greatest({rest}, {FLOOR**2 / 4}D))" if i == j else f"({rest}) / l{j}{j}"
    for j in _P:
        named[f"w{j}{j}"] = f"1 / l{j}{j}"
        for i in range(j + 1, len(DIMS)):
            named[f"w{i}{j}"] = f"-({' + '.join(f'l{i}{k} * w{k}{j}' for k in range(j, i))}) / l{i}{i}"
    named["log_det"] = " + ".join(f"2 * ln(l{i}{i})" for i in _P)
    out = moments.selectExpr("*", *(f"{e} AS {n}" for n, e in named.items()))
    return out.select(*keys, "log_det", *(f"m{i}" for i in _P), *(f"w{i}{j}" for i, j in _PAIRS))


def _distance(at: str = "") -> Column:
    y = [" + ".join(f"{at}w{i}{j} * ({DIMS[j]} - {at}m{j})" for j in range(i + 1)) for i in _P]
    return F.expr(" + ".join(f"power({x}, 2)" for x in y))


def _attach(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with what ``found`` (unique by g) says of their group: broadcast where that is small, else hot groups apart."""
    small = few(found)
    return rows.join(small, "g", "left") if small is not found else lookup(rows, found, "g")


def _medians(rows: DataFrame, values: list[Column]) -> DataFrame:
    """Per g: v0, v1, ... the medians of the values, from histograms of ``FINE`` buckets a unit."""
    n = range(len(values))
    each = rows.select("g", F.posexplode(F.array(*(F.floor(v * FINE).cast("long") for v in values))).alias("dim", "bucket"))
    held = each.groupBy("g", "dim", "bucket").agg(F.count("*").alias("n"))
    order = Window.partitionBy("g", "dim")
    at = held.withColumn("below", F.sum("n").over(order.orderBy("bucket"))).withColumn("all", F.sum("n").over(order)).where("2 * below >= all")
    return at.groupBy("g").agg(*(((F.min(F.when(F.col("dim") == i, F.col("bucket"))) + 0.5) / FINE).alias(f"v{i}") for i in n))


def estimates(vectors: DataFrame, ws: Workspace) -> DataFrame:
    """Per g: n, log_det, means and W.  g is (language, source), or a language with all its sources."""
    rows = ws.save(vectors.where("not base_failed").select(F.explode(F.array("own", "wide")).alias("g"), *DIMS), "rows")
    middle = ws.save(_medians(rows, [F.col(d) for d in DIMS]), "middle")
    centred = _attach(rows, middle).selectExpr("g", *(f"v{i} AS m{i}" for i in _P), *(f"{d} - v{i} AS {d}" for i, d in enumerate(DIMS)))
    spread = ws.save(_medians(centred, [F.abs(F.col(d)) for d in DIMS]).selectExpr("g", *(f"greatest(1.4826D * v{i}, {FLOOR}D) AS s{i}" for i in _P)), "spread")
    norm = f"sqrt({' + '.join(f'power({d} / s{i}, 2)' for i, d in enumerate(DIMS))})"
    scored = _attach(centred, spread).selectExpr("*", f"{norm} AS norm", *(f"tanh({d} / s{i}) AS a{i}" for i, d in enumerate(DIMS)))
    scored = scored.selectExpr("*", *(f"if(norm > 0, {d} / s{i} / norm * {len(DIMS) ** 0.5}D, 0D) AS b{i}" for i, d in enumerate(DIMS)))
    moments = scored.groupBy("g").agg(*map(F.expr, ["count(*) AS n", *(f"first({x}{i}) AS {x}{i}" for x in "ms" for i in _P), *(f"avg({x}{i} * {x}{j}) AS {x}{i}{j}" for x in "ab" for i, j in _PAIRS)]))
    shapes = [lambda i, j: f"{float(i == j)}D", lambda i, j: f"a{i}{j}", lambda i, j: f"b{i}{j}"]
    forms = [f"struct({start} AS start, {', '.join(f'{shape(i, j)} * s{i} * s{j} / {CONSISTENCY}D AS c{i}{j}' for i, j in _PAIRS)})" for start, shape in enumerate(shapes)]
    starts = moments.selectExpr("g", "n", *(f"m{i}" for i in _P), f"inline(array({', '.join(forms)}))")
    keys = ["g", "start", "n"]
    model = ws.save(_factor(starts, keys), "mcd_0")
    for turn in range(1, STEPS + 1):
        listed = model.groupBy("g").agg(F.collect_list(F.struct("start", *(c for c in model.columns if c[0] in "mw"))).alias("models"))
        near = _attach(rows, listed).select("g", *DIMS, F.explode("models").alias("m"))
        bucket = F.floor(OCTAVE * F.log2(_distance("m.") + 2.0**-20)).cast("int").alias("bucket")
        sums = [f"t{i}" for i in _P] + [f"t{i}{j}" for i, j in _PAIRS]
        adds = ["count(*) AS held", *(f"sum({d}) AS t{i}" for i, d in enumerate(DIMS)), *(f"sum({DIMS[i]} * {DIMS[j]}) AS t{i}{j}" for i, j in _PAIRS)]
        rings = near.select("g", "m.start", bucket, *DIMS).groupBy("g", "start", "bucket").agg(*map(F.expr, adds))
        inner = rings.selectExpr("*", "sum(held) OVER (PARTITION BY g, start) AS n", "sum(held) OVER (PARTITION BY g, start ORDER BY bucket) - held AS before").where(f"before < {SUBSET} * n")
        total = inner.groupBy(*keys).agg(*map(F.expr, [f"sum({x}) AS {x}" for x in ("held", *sums)]))
        moved = total.selectExpr(*keys, *(f"t{i} / held AS m{i}" for i in _P), *(f"t{i}{j} / held - t{i} / held * t{j} / held AS c{i}{j}" for i, j in _PAIRS))
        after = ws.save(_factor(moved, keys), f"mcd_{turn}")
        change = model.select("g", "start", F.col("log_det").alias("was")).join(after, ["g", "start"]).agg(F.max(F.abs(F.col("log_det") - F.col("was")))).first()[0]
        ws.drop(f"mcd_{turn - 1}")
        model = after
        if change is None or turn > 1 and change < STILL:
            break
    names = [c for c in model.columns if c not in ("g", "start")]
    best = model.groupBy("g").agg(F.min(F.struct("log_det", "start", *(c for c in names if c != "log_det"))).alias("low"))
    return best.select("g", *(F.col(f"low.{c}").alias(c) for c in names))


def quality_rules(docs: DataFrame, least_rows: int = 50) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    base_failed: fewer than 50 words, or more than half of them in repeated 3-word windows.  kept: not base_failed and
    the Mahalanobis distance (squared in ``distance``) within the cut.  A (language, source) of fewer than ``least_rows``
    rows that pass the base is judged by its language's estimate.  Null and empty texts fail the base; null
    languages and sources are groups of their own; missing lang or source columns make one group.  Ties and constant
    vectors are held by the covariance's floor; repeated rows count each; an empty table has no rows; other columns are
    ignored.
    """
    ws = Workspace(docs.sparkSession, "quality")
    stats = counts(docs).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("?"))
    wide = F.concat(F.length(named("lang")).cast("string"), named("lang"))
    vectors = _vectors(stats).withColumn("wide", wide).withColumn("own", F.concat(wide, named("source"))).drop("lang", "source")
    vectors = ws.save(vectors, "vectors")
    model = ws.save(estimates(vectors, ws), "mcd")
    entries = [c for c in model.columns if c[0] in "mw"]
    widely = vectors.where("not base_failed").select("own", "wide").distinct()
    coarse = model.select(F.col("g").alias("wide"), F.struct(*entries).alias("coarse"))
    judge = model.select(F.col("g").alias("own"), "n", F.struct(*entries).alias("fine")).join(widely, "own").join(coarse, "wide")
    judge = judge.select(F.col("own").alias("g"), F.when(F.col("n") >= least_rows, F.col("fine")).otherwise(F.col("coarse")).alias("model"))
    judge = ws.save(judge.select("g", "model.*"), "judge")
    judged = _attach(vectors.withColumnRenamed("own", "g"), judge).withColumn("distance", F.coalesce(_distance(), F.lit(0.0)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("distance") <= CUTOFF)).alias("kept"), "distance")


def query(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))
