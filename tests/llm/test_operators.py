"""Each operator on small, awkward tables, and against brute force."""

import base64
import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, ngram_join, packing, pii, quality_knn, quality_rules, token_scan, toxic_crf, url_filter, warc
from tessera.llm.workspace import Workspace

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n string, cls string"
_WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = " ".join(_WORDS[(i * i + i // 7) % 20] + str(i % 50) for i in range(400))


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(1, LONG), (2, LONG + " end"), (3, LONG), (3, LONG), (4, None), (5, ""), (6, "  \n\t "), (7, "two words"), (None, "two words"), (8, "É x\u00a0y " * 3000), (9, None)]
    return spark.createDataFrame([(i, t, None, None, None, "x", "y") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark", "pages")}


def shingles(text, k, pattern=r"[^\x20\x09-\x0D]+"):
    w = re.findall(pattern, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def test_join_awkward(awkward, empty):
    got = collections.Counter((r.doc_id, r.component_id) for r in ngram_join.ngram_jaccard_join(awkward).collect())
    assert got == collections.Counter([(1, 1), (2, 1), (3, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 7), (None, 7), (8, 8), (9, 9)])
    assert ngram_join.ngram_jaccard_join(empty).count() == 0
    kept = sorted((r.doc_id for r in ngram_join.keep_one_of_each(awkward).collect()))
    assert kept == [1, 4, 5, 6, 7, 8, 9]
    text = " ".join(f"other{i}" for i in range(30))
    rows = [(7, "two words"), (None, "two words"), (None, "other"), (None, "other"), (1, LONG), (3, LONG + " x"), (3, text), (3, text), (4, None), (4, None)]
    docs = empty.sparkSession.createDataFrame([(i, t, None, None, None, "x", "y") for i, t in rows], SCHEMA)
    kept = sorted(((r.doc_id or 0, (r.text or "")[:6]) for r in ngram_join.keep_one_of_each(docs).collect()))
    assert kept == sorted([(7, "two wo"), (0, "other"), (1, LONG[:6]), (3, text[:6]), (4, ""), (4, "")])
    assert ngram_join.keep_one_of_each(empty).count() == 0


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_join_brute_force(spark, tables, k, percent):
    # near copies of one text with growing numbers of edits, beside the table's own
    extra = []
    for i in range(60):
        w = LONG.split()
        for j in range(i % 14):
            w[(i * 37 + j * 53) % len(w)] = f"edit{i % 9}x{j}"
        extra.append((10_000 + i, " ".join(w)))
    docs = tables["documents"].select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    sets = {r.doc_id: shingles(r.text, k) for r in docs.collect()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * (s := len(x & y)) >= percent * (len(x) + len(y) - s):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in ngram_join.ngram_jaccard_join(docs, k, percent).collect()}
    assert got == {i: (find(i), len(sets[i])) for i in sets}


@pytest.mark.parametrize("block", [1024, 3])
def test_join_counts_all_links(spark, monkeypatch, block):
    # an original and 40 copies with one edit each, edited copies of copies, and a pair of their own
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    base = LONG.split()
    texts = [LONG] + [" ".join([*base[:j], f"edit{j}", *base[j + 1 :]]) for j in range(0, 400, 10)]
    texts += [" ".join(w if j % 40 else f"far{i}x{j}" for j, w in enumerate(base) if j < 300 + i) for i in range(12)]
    texts += [" ".join(f"pair{j}" for j in range(60)), " ".join(f"pair{j}" for j in range(58)), texts[5], None]
    sets = {t: shingles(t, 4) for t in texts}
    links = {t: sum(bool(u != t and x and y and 100 * len(x & y) >= 85 * len(x | y)) for u, y in sets.items()) for t, x in sets.items()}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in ngram_join.ngram_jaccard_join(docs, 4, 85).collect()}
    assert got == {i: links[t] for i, t in enumerate(texts)} and links[LONG] >= 40 and min(links[t] for t in texts[1:41]) >= 40


def test_quality_rules(spark, awkward, empty, tables):
    assert quality_rules.quality_rules(empty).count() == 0
    assert {r.doc_id: r.kept for r in quality_rules.quality_rules(awkward).collect()}[4] is False
    got = {r.doc_id: r for r in quality_rules.quality_rules(tables["documents"]).collect()}
    for d in tables["documents"].collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        times, covered = collections.Counter(grams), set()
        for i, g in enumerate(grams):
            if times[g] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in d.text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", d.text)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_determinants(spark):
    """The estimates against random-start concentration in numpy: no larger a determinant, and the same verdicts."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = range(len(quality_rules.DIMS))
    rows = Workspace(spark, "rows").save(quality_rules._vectors(quality_rules.counts(docs)), "rows").where("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words")
    model = {r.g: r for r in quality_rules.estimates(rows.selectExpr("*", "'own' AS own", "lang AS wide", "false AS base_failed"), Workspace(spark, "mcd")).collect()}
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, least_rows=10**9).collect()}
    held = rows.collect()
    rng, same = np.random.default_rng(5), 0
    for lang in sorted({r.lang for r in held}):
        own = [r for r in held if r.lang == lang]
        x = np.array([[r[d] for d in quality_rules.DIMS] for r in own])
        h = int(np.ceil(quality_rules.SUBSET * len(x)))

        def fit(some):
            cov = np.cov(some.T, bias=True) * quality_rules.CONSISTENCY + np.eye(len(p)) * quality_rules.FLOOR**2
            gap = x - some.mean(0)
            return np.linalg.slogdet(cov)[1], (gap @ np.linalg.inv(cov) * gap).sum(1)

        best = (np.inf, None)
        for _ in range(20):
            some = x[rng.choice(len(x), len(p) + 1, replace=False)]
            for _ in range(30):
                det, d = fit(some)
                some = x[np.argsort(d, kind="stable")[:h]]
            best = min(best, fit(some), key=lambda b: b[0])
        assert model[lang].log_det <= best[0] + 0.15 and model[lang].n == len(x)
        same += sum(kept[r.doc_id] == (v <= quality_rules.CUTOFF) for r, v in zip(own, best[1], strict=True))
    assert same >= 0.98 * len(held)


def test_quality_groups(spark, empty):
    """Null and empty languages and sources are groups apart; shapes beyond a broadcast go the salted way."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60 + i % 7)), (None, "", "en")[i % 3], (None, "")[i % 2], None, "x", "y") for i in range(90)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("g", F.lit("clash")).withColumn("m0", F.lit(1))
    got = {r.doc_id: (r.kept, r.distance) for r in quality_rules.quality_rules(docs, least_rows=5).collect()}
    assert len(got) == 90 and all(k for k, _ in got.values())
    few, quality_rules.few = quality_rules.few, lambda df: df
    try:
        again = {r.doc_id: (r.kept, r.distance) for r in quality_rules.quality_rules(docs, least_rows=5).collect()}
        assert all(got[i][0] == k and abs(got[i][1] - d) < 1e-9 for i, (k, d) in again.items()) and len(again) == 90
    finally:
        quality_rules.few = few


def test_decontamination(spark, awkward, empty, tables):
    benchmark = tables["benchmark"]
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(awkward, spark.createDataFrame([], "item_id long, text string")).collect()} == {0}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = collections.defaultdict(set)
    for r in benchmark.collect():
        w = words(r.text)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].add(str(r.item_id))
    sizes = {len(k) for k in windows}
    got = {r.doc_id: r for r in decontaminate.contamination(tables["documents"], benchmark).collect()}
    for d in tables["documents"].collect():
        w, hit, items = words(d.text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if found := windows.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    items |= found
        r = got[d.doc_id]
        assert (r.n_words, r.n_hit, r.items_sha256) == (len(w), len(hit), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
    assert any(r.contaminated for r in got.values())
    left = decontaminate.contamination(decontaminate.decontaminate(tables["documents"], benchmark), benchmark)
    assert left.where("contaminated").isEmpty()


def test_warc(spark, tables, empty):
    long = "y" * 50000 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(3, "u://a", "xx"), (1, None, "xx"), (2, "u", ""), (7, "u\r\nX: y", None), (9, "q", long), (9, "q", long), (None, "n", long), (None, None, "only"), (None, None, "only"), (4, "é", "é" * 9000)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("k")).withColumn("row", F.lit(0)).withColumn("first", F.lit(1))
    ws = Workspace(spark, "t")
    got = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(docs, ws).collect())
    assert got == collections.Counter([(1, 2, "response", None), (3, 2, "revisit", 1), (2, 0, "response", None), (7, 0, "revisit", 2), (9, 50014, "response", None), (9, 50014, "revisit", 9), (None, 50014, "revisit", 9),
                                       (None, 4, "response", None), (None, 4, "revisit", None), (4, 18000, "response", None)])
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none, ws).count() == 0 and warc.read(ws, warc.write(none, ws, "none")).count() == 0
    pages = tables["pages"].union(tables["pages"].selectExpr("page_id + 1000", "url", "html").where("page_id % 7 = 1"))
    listed = [(p.page_id, base64.b32encode(hashlib.sha1(p.html.encode()).digest()).decode(), len(p.html.encode())) for p in pages.collect()]
    lowest = {}
    for i, d, _ in listed:
        lowest[d] = min(i, lowest.get(d, i))
    want = {i: (n, d, "response" if lowest[d] == i else "revisit", None if lowest[d] == i else lowest[d]) for i, d, n in listed}
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages, ws).collect()} == want
    back = {r.page_id: r.payload for r in warc.read(ws, warc.write(tables["pages"], ws, "full")).collect()}
    assert back == {p.page_id: p.html.encode() for p in tables["pages"].collect()}


def test_warc_files(spark, tmp_path):
    """Plain and gzip archives as other writers make them, and archives that are cut."""
    import gzip

    rows = [r for i in range(3) for r in warc.records(i, "u", b"z" * (20000 * i), i, None)]
    info = warc._record(b"warcinfo", "info", [], b"software: x")
    (tmp_path / "a.warc").write_bytes(info + b"".join(rows))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(info + b"".join(rows[:1])) + b"".join(map(gzip.compress, rows[1:])))
    got = warc.read(Workspace(spark, "t"), f"file://{tmp_path}/a.warc").collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(0, 0), (1, 20000), (2, 40000)]
    heads = [h["warc-record-id"] for h, _ in warc.parse((tmp_path / "b.warc.gz").read_bytes())]
    assert len(heads) == len(rows) + 1
    for bad in (b"".join(rows)[:-5], gzip.compress(rows[0])[:-9], b"x" + rows[0]):
        with pytest.raises(ValueError):
            list(warc.parse(bad))
    with pytest.raises(ValueError):
        warc.unchunk(b"5\r\nab\r\n0\r\n\r\n")
    lost = [r for r in rows if b"WARC-Segment-Number: 2\r\n" not in r]
    (tmp_path / "lost.warc").write_bytes(b"".join(lost))
    with pytest.raises(Exception, match="segments are missing"):
        warc.read(Workspace(spark, "t"), f"file://{tmp_path}/lost.warc").collect()


def test_pii(awkward, empty):
    assert pii.identifiers(empty).count() == 0 and pii.identifiers(awkward).count() == 11
    found = lambda t: [(k, t[s:e]) for k, s, e in pii.find_all(t)[1]]
    assert found("a joe (at) corp (dot) com b") == [("email", "joe (at) corp (dot) com")]
    assert found("jоe＠mail.com") == [("email", "jоe＠mail.com")]
    assert found("look at once dot") == [] and found("see the dot at noon") == []
    assert found("call plus one five five five one two three four five six seven now")[0][0] == "phone"
    assert found("x@y.z 10.0.0.1, 300.1.1.1, 4111 1111 1111 1111, +1 (988) 555-2485") == [("email", "x@y.z"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (988) 555-2485")]
    assert pii.mask("mail x@y.z or 10.0.0.1") == "mail <email> or <ip>"


@pytest.mark.parametrize(("kind", "text"), [
    ("email", "john @ example.com"), ("email", "x@host_dot_com"), ("email", "joe at corp dot\ncom"), ("email", "joe at corp\tdot\tcom"),
    ("email", "a.b.c.d.e.f at corp dot com"), ("email", "a dot b dot c dot d dot e at corp dot com"),
    ("phone", "plus one two one six two one one two one two"),
    ("ip", "10 dot 0 dot 0 dot 1"), ("ip", "8 dot 8 dot 8 dot 8"), ("ip", "192[.]168[.]10[.]5"), ("ip", "192.168.10[.]5"), ("ip", "one dot two dot three dot four"),
])
def test_pii_each_disguise_alone(kind, text):
    plain = f"; {text}; and so on"
    assert [(k, plain[s:e]) for k, s, e in pii.find_all(plain)[1]] == [(kind, text)] and pii.find(plain) == []


def test_tokens_and_packing(spark, awkward, empty, tables):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    assert packing.pack(empty, path).count() == 0
    for docs in (awkward, tables["documents"]):
        rows = packing.pack(docs, path).collect()
        want = collections.Counter()
        for r in docs.collect():
            n = len(own.encode(r.text or "", add_special_tokens=False).ids) + 1
            want[r.doc_id] += n
        assert collections.Counter({k: sum(r.length for r in rows if r.doc_id == k) for k in want}) == want
        by = collections.defaultdict(list)
        for r in rows:
            by[r.sequence_id].append((r.offset, r.length))
        for parts in by.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
        assert len(by) <= 1 + -(-sum(r.length for r in rows) // 4096) * 1.02
    sizes = sorted(len(own.encode(r.text or "", add_special_tokens=False).ids) for r in tables["documents"].collect())
    token_scan.write_flat(tables["documents"], path, Workspace(spark, "t").path("flat"))
    assert sorted(r.n_tokens for r in token_scan.token_counts(tables["documents"], path).collect()) == sizes
    for docs in (awkward, tables["documents"]):
        want = collections.Counter((r.doc_id, len(own.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
        assert collections.Counter((r.doc_id, r.n_tokens) for r in token_scan.token_counts(docs, path).collect()) == want
    assert token_scan.token_counts(empty, path).count() == 0
    ws = Workspace(spark, "small")
    token_scan.write_flat(awkward, path, ws.path("flat"))
    assert sorted(r.n_tokens for r in token_scan.scan(ws, ws.path("flat"), block=64, width=256).collect()) == sorted(len(own.encode(r.text or "", add_special_tokens=False).ids) for r in awkward.collect())


@pytest.mark.parametrize(("operator", "target", "least"), [(quality_knn.classify, "quality", 0.95), (toxic_crf.toxicity, "toxic", 0.8)])
def test_learned(spark, awkward, empty, tables, operator, target, least):
    big = {t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")}
    held = operator(big["documents"], big["labels"]).where("held_out").join(big["labels"], "doc_id").select("predicted", target).collect()
    assert sum(r.predicted == r[target] for r in held) / len(held) >= least
    assert operator(empty, tables["labels"]).count() == 0
    doubled = big["documents"].limit(200).union(big["documents"].limit(200))
    assert operator(doubled, big["labels"]).count() == 400
    assert all(0 <= r.score <= 1 for r in operator(awkward, tables["labels"]).collect())
    assert operator(awkward, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 11


def test_chain_marginals():
    """Forward-backward against all labellings of short chains, and block-wise against token by token on a long one."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(7)
    move = rng.normal(size=(2, 2))
    first = np.array([0, 1, 1, 9, 14])
    emission = rng.normal(scale=2, size=14)
    p = toxic_crf._forward_backward(emission, first, move)[0]
    for low, high in itertools.pairwise(first):
        weight = {y: np.exp(sum(e * v for e, v in zip(emission[low:high], y, strict=True)) + sum(move[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=high - low)}
        for t in range(high - low):
            assert abs(p[low + t] - sum(w for y, w in weight.items() if y[t]) / sum(weight.values())) < 1e-9
    emission, first = rng.normal(scale=3, size=7000), np.array([0, 5000, 5003, 7000])
    whole = toxic_crf._forward_backward(emission, first, move)[0]
    stride, toxic_crf.STRIDE = toxic_crf.STRIDE, 1 << 30
    try:
        assert np.abs(whole - toxic_crf._forward_backward(emission, first, move)[0]).max() < 1e-9
    finally:
        toxic_crf.STRIDE = stride


def test_long_texts(spark, tables):
    """A text of a million words costs seconds, not minutes."""
    from pyspark.sql import functions as F

    docs = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.expr("repeat('some plain words ', 350000)").alias("text"))
    assert 0 <= toxic_crf.toxicity(docs, tables["labels"]).first().score < 0.7
    assert pii.find("a" * 60_000 + "@" + "1." * 30_000) is not None


def test_nearest_votes(spark, tables):
    """Blocked votes against every cosine, one document at a time."""
    import numpy as np
    import pyarrow as pa

    model = quality_knn.fit(tables["documents"], tables["labels"])
    texts = [r.text for r in tables["documents"].collect()][:60] + ["", None]
    for low, x in quality_knn.features(pa.array(texts)):
        got = model.score(x)
        for row, score in zip(x, got, strict=True):
            if not row.any():
                assert score == model.prior
                continue
            v = (row * model.weights) @ model.basis
            cosine = model.vectors @ (v / max(np.linalg.norm(v), 1e-9))
            near = np.argsort(-cosine, kind="stable")[: quality_knn.NEIGHBOURS]
            vote = np.maximum(cosine[near], 1e-3) ** quality_knn.POWER
            assert abs(score - (vote * model.labels[near]).sum() / vote.sum()) < 1e-3


def test_quality_fit_is_bounded(spark):
    """A full sample with nearly every feature in use: never dense as a whole on the driver."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(3)
    signs = np.array(list("ab0é \n~#*$%&|<>!?.,:;-\"'()"))
    rows = [(i, "".join(rng.choice(signs[i % 2 :], 900)), i % 2) for i in range(4700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    tracemalloc.start()
    try:
        model = quality_knn.fit(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model.labels) == 2 * quality_knn.MOST and peak < 180 << 20


def test_strongest_directions():
    """Against the whole decomposition: falling spectra, repeated values, fewer directions than asked for."""
    import numpy as np

    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.standard_normal((800, 800)))[0]
    for values in (0.97 ** np.arange(800), np.repeat(0.9 ** np.arange(80), 10), np.where(np.arange(800) < 5, 1.0, 0.0), np.zeros(800)):
        matrix = ((turn * values) @ turn.T).astype(np.float32)
        power, left = quality_knn.strongest(matrix, 32)
        want = np.linalg.eigvalsh(matrix.astype(float))[:-33:-1]
        assert np.abs(power - want).max() < 1e-6 and np.abs(left.T @ left - np.eye(32)).max() < 1e-9
        assert np.abs(matrix @ left - left * power).max() < 1e-5


def test_url_filter(spark, tables):
    urls = ["https://www.lucky-casino.example.net/en/3", "https://Blog.garden-notes.Example.net/en/3?x", "http://a.example.org/es/1", "http://a.example.org/x", "http://b.com/de/", "nothing", None, "http://c.org", "HTTP://É.Org?a/b", "://", "x://h#/p", "http://" + "a" * 100_000 + ".net/" + "b" * 100_000]
    docs = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("label", F.lit(1))
    got = {r.page_id: r for r in url_filter.url_filter(docs).collect()}
    assert [got[i].verdict for i in range(5)] == ["block", "allow", "block", "allow", "block"]
    assert (got[1].host, got[1].path, got[2].rule, got[3].rule) == ("blog.garden-notes.example.net", "/en/3", "example.org/es/", "org/")
    assert (got[5].host, got[6].path, got[7].rule) == ("", "", None) and (got[8].host, got[8].path, got[9].host, got[10].host, got[10].path) == ("É.org".lower().replace("é", "É"), "", "", "h", "")
    assert len(got[11].host) == 100_004 and len(got) == len(urls)
    assert url_filter.url_filter(docs.limit(0)).count() == 0
    assert {r.score for r in url_filter.url_filter(docs, labelled=docs.select("url", "label").limit(0)).collect()} == {0.5}
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    got = {r.page_id: r for r in url_filter.url_filter(tables["pages"]).collect()}
    for p in tables["pages"].collect():
        host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", p.url).groups()
        fit = next((r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])), None)
        r = got[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, fit and fit[0] + fit[1]) and (fit is None or r.verdict == fit[2])


def test_url_regression(spark):
    """The fold over two arrays equals the same steps in numpy, and tells held-out urls of the table apart."""
    import numpy as np

    table = url_filter.training_table(spark, False)
    host, path = url_filter._parts("url")
    rows = table.select("label", host.alias("h"), path.alias("p")).select("label", url_filter._slots("h", "p").alias("s")).collect()
    x = np.zeros((len(rows), url_filter.SLOTS + 1))
    for i, r in enumerate(rows):
        np.add.at(x[i], r.s, len(r.s) ** -0.5)
    y, w, speed = np.array([r.label for r in rows]), np.zeros(x.shape[1]), np.full(x.shape[1], 1e-12)
    for _ in range(5):
        d = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + url_filter.SHRINK * w
        speed += d * d
        w = w - url_filter.RATE * d / np.sqrt(speed)
    assert np.abs(np.array(url_filter.train(table, 5)) - w).max() < 1e-6
    held = url_filter.training_table(spark, True).select("url", "label", F.monotonically_increasing_id().alias("page_id"))
    right = url_filter.url_filter(held, (), table).join(held, "page_id").select(((F.col("verdict") == "block") == (F.col("label") == 1)).alias("ok")).collect()
    print("held-out urls right:", sum(r.ok for r in right), "of", len(right))
    assert sum(r.ok for r in right) / len(right) > 0.9


def test_pipeline(spark, tables):
    import corpus_pipeline

    docs = tables["documents"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = Workspace(spark, "p").save(out, name)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == docs.count()
