"""Filter audit, context-tree scores and periodic runs against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from conftest import edge_rows, prose
from pyspark.sql import functions as F

from terrapix.llm import context_tree, filter_audit, periodic_runs

SPACES = " \t\n\v\f\r"


def words_of(t):
    out, w = [], ""
    for ch in (t or "") + " ":
        if ch in SPACES:
            if w:
                out.append(w)
            w = ""
        else:
            w += ch
    return out


def crc(i):
    return zlib.crc32(b"" if i is None else str(i).encode())


# ---------------------------------------------------------------- filter audit

def plain_fails(rows):
    firsts = {}
    for i, t, *_ in rows:
        if i is not None:
            firsts[t or ""] = min(firsts.get(t or "", i), i)
    out = []
    for i, t, part in rows:
        t = t or ""
        w = words_of(t)
        bad = ""
        bad += "A" * (len(w) < 200)
        bad += "B" * (100 * len(set(w)) < 50 * len(w))
        bad += "C" * (100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t))
        bad += "D" * any(c in "#$%&*|" for c in t)
        bad += "E" * (i is not None and firsts[t] < i)
        out.append((part or "", bad, i))
    return out


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails = plain_fails(rows)
    out = []
    for part in {p for p, _, _ in fails}:
        own = [(set(b), i) for p, b, i in fails if p == part]
        total = Counter()
        mine = []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                total[f] += len(gone)
                mine.append((part, "".join(order), step, len(left), len(gone), sum(f in b for b, _ in own) - len(gone),
                             sum(b == {f} for b, _ in own), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)))
        out += [(*m, total[m[1][m[2] - 1]]) for m in mine]
    return Counter(out)


def audit_rows():
    rng = random.Random(3)
    rows = [(i, t, "en" if k % 3 else None) for k, (i, t) in enumerate(edge_rows())]
    for i in range(100, 260):
        t = prose(rng.choice([20, 210, 260]), rng.randint(0, 30))
        if rng.random() < 0.3:
            t = t.upper()
        if rng.random() < 0.3:
            t += " 50%"
        if rng.random() < 0.3:
            t = " ".join(["again and"] * 150) + "\v" + t
        rows.append((i, t, rng.choice(["en", "fr", ""])))
    return rows


def test_audit_matches_every_order_run_on_documents(spark):
    rows = audit_rows()
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(1, 200, 2)] + [(3, 0, 1), (3, 1, None), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, part string, mask string")
    got = filter_audit.audit_filters(docs.repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == [c.split()[0] for c in filter_audit.AUDIT_SCHEMA.split(", ")]
    assert Counter(tuple(r) for r in got.collect()) == plain_audit(rows, labels)


def test_audit_of_nothing_and_without_labels(spark, nothing, edges):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(nothing, labels).count() == 0
    rows = filter_audit.audit_filters(edges, labels).collect()
    assert len(rows) == 600 * len({r["part"] for r in rows})
    assert all(r["good_lost"] == r["toxic_lost"] == 0 for r in rows)


def test_walk_toggles_one_filter_a_step():
    rng = np.random.default_rng(0)
    cells = [(m, (int(n), int(n) // 2, 0)) for m, n in enumerate(rng.integers(0, 50, 32))]
    states = filter_audit.walk(cells, 5)
    for s in range(32):
        assert states[s].tolist() == [sum(c[j] for m, c in cells if m & s == 0) for j in range(3)]


# ---------------------------------------------------------------- context tree

class PlainTree:
    """Sequence probabilities by the definition: a product over contexts, one bit at a time."""

    def __init__(self, depth):
        self.depth, self.counts, self.kids = depth, {}, {}

    def path(self, context, node):
        return [(context[len(context) - d:], node) for d in range(self.depth + 1)]

    def add(self, context, byte, n):
        node = 1
        for j in range(7, -1, -1):
            bit = byte >> j & 1
            for d, key in enumerate(self.path(context, node)):
                c = self.counts.setdefault(key, [0, 0])
                c[bit] += n
                if d < self.depth:
                    self.kids.setdefault(key, set()).add(self.path(context, node)[d + 1])
            node = 2 * node + bit

    def weigh(self, key, d, more):
        a, b = self.counts.get(key, (0, 0))
        if key in more:
            a, b = a + (more[key] == 0), b + (more[key] == 1)
        pe = math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if d == self.depth:
            return pe
        kids = self.kids.get(key, set()) | {k for k in more if len(k[0]) == d + 1 and k[0][1:] == key[0] and k[1] == key[1]}
        below = sum(self.weigh(k, d + 1, more) for k in kids)
        top = max(pe, below)
        return top + math.log(.5 * math.exp(pe - top) + .5 * math.exp(below - top))

    def predict(self, context, byte):
        node, total = 1, 0.0
        for j in range(7, -1, -1):
            bit = byte >> j & 1
            more = dict.fromkeys(self.path(context, node), bit)
            total += self.weigh((b"", node), 0, more) - self.weigh((b"", node), 0, {})
            node = 2 * node + bit
        return total


def plain_scores(rows, depth):
    def low(t):
        return bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())

    train = [low(t) for i, t in rows if crc(i) % 10]
    tree, tokens, known = PlainTree(depth), Counter(), {}
    for t in train:
        s = b"\xff" * depth + t + b"\xff"
        for k in range(depth, len(s)):
            tree.add(s[k - depth:k], s[k], 1)
        tokens.update(words_of(t.decode()))
        tokens["\n"] += 1
    n, v = sum(tokens.values()), len(tokens)
    out = []
    for i, t in rows:
        s, score = b"\xff" * depth + low(t) + b"\xff", 0.0
        for k in range(depth, len(s)):
            key = s[k - depth:k + 1]
            if key not in known:
                known[key] = tree.predict(key[:-1], key[-1])
            score += known[key]
        own = [tokens[w] for w in [*words_of(low(t).decode()), "\n"]]
        out.append((i, crc(i) % 10 == 0, len(own), sum(c > 0 for c in own), n,
                    sum(math.log10((c + .1) / (n + .1 * (v + 1))) for c in own), score / math.log(10)))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[6]))


def assert_scores(got, want):
    got = sorted([tuple(r)[:7] for r in got], key=lambda r: (r[0] is None, r[0] or 0, r[6]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-8, abs=1e-8)


@pytest.mark.parametrize("depth,batch,longest", [(0, 10 ** 6, 300), (2, 300, 300), (5, 10 ** 6, 60)])
def test_scores_match_the_definition(spark, monkeypatch, depth, batch, longest):
    monkeypatch.setattr(context_tree, "BATCH_BYTES", batch)
    rows = [(i, t if t is None else t[:longest]) for i, t in edge_rows()]
    rows += [(i, prose(12, i)) for i in range(100, 115)] + [(i, "Zq%d" % i * 3) for i in range(200, 215)]
    assert {crc(i) % 10 == 0 for i, _ in rows} == {True, False}
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, batch string").repartition(3)
    assert_scores(context_tree.score_documents(docs, depth=depth).collect(), plain_scores(rows, depth))


def test_probabilities_of_all_next_bytes_sum_to_one(spark):
    text = b"\xff" * 2 + b"abracadabra" + b"\xff"
    seen = Counter(text[k - 2:k + 1] for k in range(2, len(text)))
    contexts = {s[:2] for s in seen} | {b"zz", b"xr", b"xa"}
    string = np.array(sorted(int.from_bytes(c + bytes([b]), "big") for c in contexts for b in range(256)))
    n = np.array([seen[int(s).to_bytes(3, "big")] for s in string])
    node, zeros, ones = context_tree.leaf_nodes(string, n)
    rows = spark.createDataFrame(list(zip([0] * len(node), node.tolist(), zeros.tolist(), ones.tolist())),
                                 "slice int, node long, zeros long, ones long")
    got = context_tree.node_probabilities(rows, 2).toPandas()
    logs = context_tree.string_logs(string, got["node"].to_numpy(), got["one"].to_numpy())
    for c in contexts:
        assert (10 ** logs[string >> 8 == int.from_bytes(c, "big")]).sum() == pytest.approx(1, abs=1e-9)


def test_scores_of_edge_rows_and_nothing(spark, edges, nothing):
    assert context_tree.score_documents(nothing).count() == 0
    rows = context_tree.score_documents(edges).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in edge_rows())
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    none = context_tree.score_documents(edges.where(context_tree.held_out(F.col("doc_id")))).collect()
    assert none and all(r["train_tokens"] == 0 and r["bits_per_byte"] == pytest.approx(8) for r in none)


def test_held_out_texts_are_predicted_better_than_by_tokens(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    s = context_tree.score_documents(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_bytes")).first()
    assert s[0] > s[1]
    assert -s[0] * math.log2(10) / s[2] < 4


# ---------------------------------------------------------------- periodic runs

def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((a, b, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng):
    def nest(d):
        if d == 0:
            return [rng.randrange(3) for _ in range(rng.randint(1, 3))]
        w = []
        for _ in range(rng.randint(1, 3)):
            u = nest(d - 1)
            w += u * rng.randint(1, 6) + u[:rng.randint(0, len(u))] + [rng.randrange(3)] * (rng.random() < .3)
        return w[:700]

    return nest(rng.randint(1, 4))


def test_all_runs_are_found():
    rng = random.Random(11)
    cases = [[rng.randrange(k) for _ in range(rng.randint(0, 90))] for k in (1, 2, 2, 3, 4) for _ in range(120)]
    cases += [repetitive(rng) for _ in range(250)]
    a, b = [0], [0, 1]
    for _ in range(11):
        a, b = b, b + a
    tm = [0]
    for _ in range(8):
        tm += [1 - x for x in tm]
    cases += [a, b, tm, ([0, 1, 2] * 10 + [0, 1]) * 2, ([0] * 40 + [1]) * 6, ([0] * 60 + [1] + [0] * 30 + [1]) * 4,
              ([0, 1] * 30 + [0]) * 3, list(range(200)) * 3]
    got = periodic_runs.find_runs([np.array(c, dtype=np.int64) for c in cases])
    for c, g in zip(cases, got):
        assert g == brute_runs(c), c


def plain_row(i, text):
    w = words_of(text)
    h, n = crc(i), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
    runs = [(a, b, q) for a, b, q in brute_runs(w) if b - a >= max(12, 2 * q)]
    gone = {k for a, b, q in runs for k in range(a + q, b)}
    top = (None,) * 4
    if runs:
        a, b, q = sorted(runs, key=lambda r: (r[0] - r[1], r[0], r[2]))[0]
        top = (a, b - a, q, 1000 * (b - a) // q)
    listed = "".join(f"{a},{b - a},{q}\n" for a, b, q in runs)
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    return (i, n, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_run_rows_match_brute_force(spark, nothing):
    rows = [r for r in edge_rows() if r[0] != 11] + [(i, prose(60, i) + "\f\v again" * (i % 20)) for i in range(100, 260)]
    assert sum(crc(i) % 10 == 0 and bool(t) for i, t in rows) > 5
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, start string").repartition(3)
    got = Counter(tuple(r) for r in periodic_runs.periodic_runs(docs, loop=True).collect())
    assert got == Counter(plain_row(i, t) for i, t in rows)
    assert periodic_runs.periodic_runs(nothing, loop=True).count() == 0


def test_runs_of_long_texts(edges):
    rows = {r["doc_id"]: r for r in periodic_runs.periodic_runs(edges).collect()}
    assert rows[14]["n_runs"] == 1 and (rows[14]["start"], rows[14]["length"], rows[14]["period"]) == (0, 500, 1)
    assert rows[11]["n_words"] == 30_000


def test_batches_do_not_matter(edges, monkeypatch):
    whole = Counter(tuple(r) for r in periodic_runs.periodic_runs(edges, loop=True).collect())
    assert Counter(tuple(r) for r in periodic_runs.periodic_runs(edges.coalesce(1), loop=True).collect()) == whole
