"""Operators on tables of urls, labels, vectors, weights and sizes, against brute force."""

import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF001
from pyspark.sql import functions as F
from test_documents import shingle_set, similar

import corpus_pipeline
from terrapix.llm import components, jaccard_join, mixing, packing, quality, secret_scan, topk, url_filter
from terrapix.llm.queries import URL_RULES, op9_quality_classifier
from terrapix.sources.store import shared_path


# ---------------------------------------------------------------------- URLs

URLS = [
    "http://example.com/en/1", "https://www.EXAMPLE.com/en/2?x#y", "http://example.com", "http://a.net/es/", "http://net/fr/x", "xnet/es/",
    "http://anet/es/q", None, "", "://", "http://com/", "http://example.com:80/en/", "ftp://É.com/É", "http://a.com#/x", "http://a.com?x=/",
    "HTTP://sub.www.example.com/en/", "http://example.com/EN/", "http://x.net/es", "http://x.com/a\nb", "a://b://example.com/en/",
    "http://example.com/en/1",
]


def judge(u):
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        n = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
        rest = rest[n:]
        path = rest[:min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for r, v in URL_RULES:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best[0])):
            best = (r, v)
    return (host, path, *(best or (None, "allow")))


@pytest.mark.parametrize("bound", [100_000, 0])
def test_verdicts_match_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(url_filter, "MAX_BROADCAST_RULES", bound)
    rules = spark.createDataFrame(list(URL_RULES) + [(None, "block"), ("x.org/", None)], "rule string, verdict string")
    pages = spark.createDataFrame([(i, u, "old", "old") for i, u in enumerate(URLS)], "page_id long, url string, rule string, key string")
    got = url_filter.judge_urls(pages, rules)
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["key"]) for r in got.collect()) == \
        Counter((i, *judge(u), "old") for i, u in enumerate(URLS))
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_columns_of_any_name_are_kept(spark):
    rules = spark.createDataFrame(list(URL_RULES), "rule string, verdict string")
    names = ["_rule", "_verdict", "_judged_url", "a.b", "row", "key", "best", "token", "page id"]
    pages = spark.createDataFrame([(u, *[f"{n}{i}" for n in names]) for i, u in enumerate([*URLS, None, None])],
                                  "url string, " + ", ".join(f"`{n}` string" for n in names))
    got = url_filter.judge_urls(pages, rules)
    assert got.columns == ["url", *names, "host", "path", "rule", "verdict"]
    assert Counter(map(tuple, got.collect())) == Counter(
        (u, *[f"{n}{i}" for n in names], *judge(u)) for i, u in enumerate([*URLS, None, None]))
    dotted = pages.withColumnRenamed("url", "the.url")
    assert Counter(map(tuple, url_filter.judge_urls(dotted, rules, url="the.url").collect())) == Counter(map(tuple, got.collect()))


def test_wildcards_quoted_text_and_ties(spark):
    rules = spark.createDataFrame([("a.com/*/x", "block"), ("a.com/q.e\\E+/", "block"), ("*", "allow"), ("b.com/", "allow"), ("b.com/", "block")],
                                  "rule string, verdict string")
    pages = spark.createDataFrame([("http://a.com/1/2/xyz",), ("http://a.com/q.e\\E+/",), ("http://a.com/qzeE+/",), ("http://b.com/",)], "url string")
    got = {r["url"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {"http://a.com/1/2/xyz": ("a.com/*/x", "block"), "http://a.com/q.e\\E+/": ("a.com/q.e\\E+/", "block"),
                   "http://a.com/qzeE+/": ("*", "allow"), "http://b.com/": ("b.com/", "block")}


def test_rules_are_filed_under_the_rarest_token(spark):
    rules = url_filter.normalise_rules(spark.createDataFrame([("example.com/rare/", "block"), ("com/*", "allow"), ("*", "allow")],
                                                             "rule string, verdict string"))
    tokens = spark.createDataFrame([("com",)] * 5 + [("example",)] * 3 + [("rare",)], "token string")
    filed = {r["rule"]: r["token"] for r in url_filter.rarest_token_index(rules, tokens, True).collect()}
    assert filed == {"example.com/rare/": "rare", "com/*": "com", "*": ""}


# ------------------------------------------------------------------- vectors

def test_top_k_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.3, 6).round(1).tolist()) for i in range(400)]
    rows += [(7, rows[7][1]), (20, rows[20][1]), (500, None), (520, [0.1, None, 0.2, 0.3, 0.1, 0.1]), (540, [float("nan")] * 6),
             (560, [float("inf")] + [0.0] * 5), (580, []), (600, [0.0] * 6), (None, rows[3][1]), (620, [1.0, 2.0]), (640, [3.0, -1.0]),
             (660, [1e12] + [0.0] * 5), (661, [-1e12] + [0.0] * 5)]
    df = spark.createDataFrame([(i, v, "old") for i, v in rows], "vec_id long, embedding array<double>, score string")
    monkeypatch.setattr(topk, "STEP", 4)
    got = topk.top_k(df, F.pmod("vec_id", F.lit(20)) == 0, k=9, candidate_block=64, query_block=5).collect()
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows
            if v and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for a, (qid, q) in enumerate(good):
        if qid is not None and qid % 20 == 0:
            s = sorted(((-max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(q, v)))), i is None, i or 0) for b, (i, v) in enumerate(good)
                        if b != a and len(v) == len(q)))
            want.update((qid, n + 1, None if null else i, -x) for n, (x, null, i) in enumerate(s[:9]))
    assert Counter(map(tuple, got)) == want
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(df, F.lit(None).cast("boolean")).count() == 0


def test_search_stops_before_reading_all():
    data = np.zeros((5000, 3), dtype=np.int64)
    data[:40] = np.arange(40, 0, -1)[:, None] + 100
    lists = topk.Lists(data, np.arange(5000), np.arange(5000))
    seen = []
    lists.cast[np.float32] = type("Spy", (), {"__getitem__": lambda self, i: (seen.append(len(i)), data[i].astype(np.float32))[1]})()
    pos, score = lists.search(np.array([1, 1, 1]), 0, 5)
    assert pos.tolist() == [1, 2, 3, 4, 5] and sum(seen) < 1000


# --------------------------------------------------------------------- mixing

def test_raking_matches_numpy(spark):
    rng = np.random.default_rng(2)
    cells = [(f"s{i}", f"l{j}", f"t{k}", float(rng.integers(1, 1000))) for i in range(5) for j in range(3) for k in range(2) if (i + j + k) % 4]
    cells.append((mixing.MISSING, "l0", "t0", 50.0))
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens double")
    shares = {"source": [("s0", .3), ("s1", .2), ("s2", .2), ("s3", .1), ("s4", .1), (mixing.MISSING, .1)],
              "lang": [("l0", .5), ("l1", .3), ("l2", .2), ("absent", .4)], "topic": [("t0", .5), ("t1", .5)]}
    tables = {d: spark.createDataFrame(v, "value string, share double") for d, v in shares.items()}
    got = {tuple(r[:3]): r["raked"] for r in mixing.rake(df, tables, tolerance=1e-9, max_sweeps=60).collect()}
    w = np.array([c[3] for c in cells])
    total = w.sum()
    for _ in range(500):
        for d, name in enumerate(shares):
            present = sum(s for v, s in shares[name] if any(c[d] == v for c in cells))
            for v, s in shares[name]:
                on = np.array([c[d] == v for c in cells])
                if on.any():
                    w[on] *= s / present * total / w[on].sum()
    assert got.keys() == {c[:3] for c in cells}
    assert np.allclose([got[c[:3]] for c in cells], w, rtol=1e-4)


def test_budget_and_sampling(spark, edges, nothing):
    cells = spark.createDataFrame([(100.0, 150.0), (100.0, 50.0), (10.0, 1.0)], "tokens double, raked double")
    scale = mixing.budget_scale(cells, 120.0)
    assert abs(sum(min(t, scale * r) for t, r in ((100, 150), (100, 50), (10, 1))) - 120) < 1e-6
    got = mixing.mix_documents(edges, keep=0.5).collect()
    assert len(got) == edges.count() and all(0 <= r["prob"] <= 1 for r in got)
    assert all(r["row"]["weight"] == "old" and r["n_tokens"] == len((r["row"]["text"] or "").split()) for r in got)
    expected = sum(r["prob"] * r["n_tokens"] for r in got)
    assert abs(expected - 0.5 * sum(r["n_tokens"] for r in got)) < 1
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["row"]["text"], r["lang"], r["source"]), set()).add(r["sampled"])
    assert all(len(v) == 1 for v in by.values())
    assert mixing.mix_documents(nothing).count() == 0
    assert all(r["sampled"] for r in mixing.mix_documents(edges, keep=1.0).collect() if r["n_tokens"])


def test_mixing_says_how_far_it_came(spark):
    """Reachable targets end with a small residual; empty cells that rule targets out leave a large one."""
    cells = "source string, lang string, topic string, tokens double"
    full = spark.createDataFrame([(a, b, "t", float(n)) for a, b, n in (("x", "p", 5), ("x", "q", 9), ("y", "p", 2), ("y", "q", 4))], cells)
    shares = {"source": spark.createDataFrame([("x", .5), ("y", .5)], "value string, share double"),
              "lang": spark.createDataFrame([("p", .3), ("q", .7)], "value string, share double")}
    met = mixing.rake(full, shares).collect()
    assert {r["residual"] <= 1e-4 for r in met} == {True} and {r["sweeps"] < 40 for r in met} == {True}
    apart = mixing.rake(full.where("(source = 'x') = (lang = 'p')"), shares, max_sweeps=7).collect()
    assert {r["sweeps"] for r in apart} == {7} and {r["residual"] > 0.1 for r in apart} == {True}


def test_mixing_reads_texts_once_and_keeps_rows(spark):
    """Ties, a very long text and clashing columns; a row is evaluated once."""
    read = spark.sparkContext.accumulator(0)

    def note(it):
        for pdf in it:
            read.add(len(pdf))
            yield pdf

    rows = [(i, "w " * (200_000 if i in (7, 8) else i % 5), "en", "ab"[i % 2], "x", 1) for i in range(40)] + [(3, "w " * 3, "en", "b", "x", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string, _u int")
    got = mixing.mix_documents(docs.mapInPandas(note, docs.schema), keep=0.5).collect()
    assert read.value == len(rows) == len(got)
    assert sorted(tuple(r["row"]) for r in got) == sorted(rows)
    assert len({(r["prob"], r["sampled"]) for r in got if r["doc_id"] == 3}) == 1
    assert {r["n_tokens"] for r in got if r["doc_id"] == 7} == {200_000}
    assert "row" not in mixing.mix_documents(docs.limit(0), with_row=False).columns


# -------------------------------------------------------------------- packing

def best_fit_plain(sizes):
    bins = []  # [used, opened, items]
    left = sum(sizes)
    for s in sizes:
        fits = [b for b in bins if b[1] - b[0] >= s]
        if fits:
            b = min(fits, key=lambda b: b[1] - b[0])
        else:
            b = [0, packing.open_size(s, left, packing.CAPACITIES, packing.OVERHEAD)]
            bins.append(b)
        b[0] += s
        left -= s
    return Counter((u, min(c for c in packing.CAPACITIES if c >= u)) for u, _ in bins)


def test_best_fit_and_sizes(spark):
    rng = np.random.default_rng(8)
    sizes = sorted(rng.integers(1, 8193, 800).tolist() + [8192] * 3 + [1] * 50, reverse=True)
    b, offset, cap = packing.best_fit(np.array(sizes))
    used = np.bincount(b, sizes).astype(int)
    assert Counter((int(u), int(cap[b == i][0])) for i, u in enumerate(used)) == best_fit_plain(sizes)
    for i in range(len(used)):
        at = sorted(zip(offset[b == i].tolist(), np.array(sizes)[b == i].tolist()))
        assert [x for x, _ in at] == np.concatenate(([0], np.cumsum([n for _, n in at])[:-1])).tolist()
    assert packing.open_size(600, 700, packing.CAPACITIES, 64.0) == 1024
    assert packing.open_size(600, 10**6, packing.CAPACITIES, 64.0) == 8192


def test_a_bin_is_opened_for_what_can_fill_it():
    def cost(sizes):
        b, _, cap = packing.best_fit(np.array(sizes))
        return sum(int(cap[b == i][0]) + 64 for i in range(b.max() + 1))

    assert cost([3000, 3000]) == 8192 + 64  # not two of 4096
    assert cost([3000]) == 4096 + 64
    rng = np.random.default_rng(9)
    for n in range(1, 60):
        sizes = sorted(rng.integers(1, 4000, n).tolist(), reverse=True)
        u = packing.Unplaced(np.array(sizes))
        for i in (0, n // 2, n - 1):
            for c in (4096, 8192):
                room = c - sizes[i]
                for x in sizes[i + 1:]:
                    room -= x if x <= room else 0
                assert u.fill(sizes[i], i - sizes.index(sizes[i]), c) == c - room


def test_packing_keeps_every_token(spark):
    sizes = [(1, 20_000), (2, 0), (3, None), (4, -5), (5, 8192), (5, 8192), (None, 77)] + [(i, i % 3000) for i in range(10, 500)]
    df = spark.createDataFrame([(i, n, 1, 1) for i, n in sizes], "doc_id long, n_tokens long, rid int, bin_id int")
    got = packing.pack_documents(df, group_pieces=100).collect()
    want = Counter()
    for i, n in sizes:
        want[i] += max(n or 0, 0)
    have = Counter()
    for r in got:
        have[r["doc_id"]] += r["n_tokens"]
        assert (r["bin_id"] is None) == (r["n_tokens"] == 0)
    assert have == want and len([r for r in got if r["doc_id"] == 1]) == 3
    bins = {}
    for r in got:
        if r["bin_id"] is not None:
            bins.setdefault((r["bin_id"], r["capacity"]), []).append((r["offset"], r["n_tokens"]))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, cap), items in bins.items():
        items.sort()
        assert [a for a, _ in items] == np.concatenate(([0], np.cumsum([n for _, n in items])[:-1])).tolist()
        used = sum(n for _, n in items)
        assert cap == min(c for c in packing.CAPACITIES if c >= used)
    assert packing.pack_documents(df.limit(0)).count() == 0


# -------------------------------------------------------------------- quality

def auc(score, y):
    r = np.argsort(np.argsort(score)) + 1.0
    n1 = int(y.sum())
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_held_out_accuracy(spark):
    sf = SF001.replace("0.001", "0.1")
    got = op9_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    out = got[got["held_out"]]
    assert auc(out["score"].to_numpy(), out["quality"].to_numpy()) > 0.97
    assert ((out["score"] >= 0.7).astype(int) == out["predicted"]).all() and out["score"].between(0, 1).all()
    assert (out["predicted"] == out["quality"]).mean() > 0.95


@pytest.mark.parametrize("n", [0, 5, 300, 3000])
def test_the_first_rows_by_hash_are_learned_from(spark, n):
    rows = spark.range(n)
    want = rows.orderBy(F.xxhash64("id"), "id").limit(300)
    assert sorted(quality.first_hashed(rows, 300).collect()) == sorted(want.collect())


def test_features_are_a_unit_vector_of_ngrams():
    doc, bucket, value = quality.features([b"a b a b", b"", b"x", "é|é".encode()])
    n = np.bincount(doc, minlength=4)
    assert n.tolist() == [4, 0, 1, 4]  # a, b, ab, ba; nothing; x; é, |, é|, |é
    assert np.allclose(np.bincount(doc, value**2, minlength=4), [1, 0, 1, 1])


def test_ftrl_update_matches_the_formula():
    z, n = np.array([0.3, -0.2]), np.array([0.5, 0.0])
    w = np.array([-(abs(z0) - quality.L1) * np.sign(z0) / ((quality.BETA + n0**0.5) / quality.ALPHA + quality.L2) for z0, n0 in zip(z, n)])
    x = np.array([1.0, 0.5])
    p = 1 / (1 + np.exp(-(w @ x)))
    g = (p - 1) * x
    want_z = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / quality.ALPHA * w
    got_z, got_n = z.copy(), n.copy()
    quality.ftrl_pass(got_z, got_n, iter([(1.0, np.array([0, 1]), x)]))
    assert np.allclose(got_z, want_z) and np.allclose(got_n, n + g * g)


def test_scores_of_odd_rows_and_no_labels(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 0, 0), (2, 1, 0), (2, 0, 0), (8, None, 0), (10, 7, 0), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = quality.training_rows(edges, labels).collect()
    assert {(r["id"], r["y"]) for r in rows} <= {(1, 1.0), (4, 0.0)}
    model = quality.train(quality.training_rows(edges, labels))
    got = edges.select(quality.scorer(model)("text").alias("s")).collect()
    assert len(got) == edges.count() and all(0 <= r["s"] <= 1 for r in got)
    for empty in (quality.train(quality.training_rows(edges, labels.limit(0))), quality.train(quality.training_rows(nothing, labels))):
        assert not empty.trained
        assert {r["s"] for r in edges.select(quality.scorer(empty)("text").alias("s")).collect()} == {1.0}
    assert nothing.select(quality.scorer(model)("text")).count() == 0


def test_training_takes_ten_rounds(spark, edges):
    labels = spark.createDataFrame([(1, 1), (4, 0), (10, 0), (11, 1), (14, 0)], "doc_id long, quality int")
    rows = quality.training_rows(edges, labels)
    got, ten, five = quality.train(rows), quality.train(rows, rounds=10), quality.train(rows, rounds=5)
    assert got.trained and np.array_equal(got.z, ten.z) and np.array_equal(got.n, ten.n)
    assert not np.allclose(got.z, five.z)


# ----------------------------------------------------- components and pipeline

def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (160, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stages_in_order_and_their_columns(spark, edges, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "secret_scan", "source_mixing", "best_fit_packing"]
    edges.limit(0).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")) \
        .write.parquet(str(tmp_path / "labels.parquet"))
    docs = edges
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == edges.columns, name
        assert docs.schema.simpleString() == edges.schema.simpleString()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, edges.limit(0), str(tmp_path)).count() == 0


def test_pipeline_matches_its_stages_in_plain_python(spark):
    """Decisions of each stage over the smallest tables, redone without Spark's operators where the rule is exact."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    model = quality.train(quality.training_rows(docs, labels))
    scored = docs.select("*", quality.scorer(model)("text").alias("s")).collect()
    kept = [r for r in scored if r["s"] >= 0.7]
    stage1 = corpus_pipeline.quality_stage(spark, docs, SF001)
    assert {r["doc_id"] for r in stage1.collect()} == {r["doc_id"] for r in kept}
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in kept}
    stage2 = corpus_pipeline.near_duplicate_stage(spark, stage1, SF001).collect()
    stay = {r["doc_id"] for r in stage2}
    for d, s in sets.items():  # who stays is like nobody else who stays; who goes is linked to a smaller id
        like = [e for e, t in sets.items() if e != d and similar(s, t)]
        assert not stay & set(like) if d in stay else like
    frame = spark.createDataFrame(stage2, docs.schema)
    stage3 = corpus_pipeline.secrets_stage(spark, frame, SF001).collect()
    again = secret_scan.scan_versions(spark.createDataFrame(stage3, docs.schema), shared_path(spark, "test-ledger"))
    assert len(stage3) == len(stage2) and again.where(F.size("spans") > 0).count() == 0
    assert all(r["n_chars"] == len(r["text"]) for r in stage3)
    packed = corpus_pipeline.run(spark, SF001).toPandas()
    words = {r["doc_id"]: len(r["text"].split()) for r in stage3}
    total = packed.groupby("doc_id")["n_tokens"].sum()
    assert set(total.index) <= set(words) and all(words[d] == n for d, n in total.items())
    assert 0.6 * sum(words.values()) < total.sum() <= sum(words.values())
    assert jaccard_join.THRESHOLD == 0.8
