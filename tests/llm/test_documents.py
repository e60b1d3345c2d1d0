"""Document operators against brute force on rows with every edge case."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import edge_rows, prose
from pyspark.sql import functions as F

from terrapix.llm import fingerprint, jaccard_join, secret_scan, substring_dedup, token_store
from terrapix.llm.queries import tokenizer_path
from terrapix.llm.text_hash import names
from terrapix.sources.store import shared_path


def key(i):
    return (i is None, i or 0)


# ---------------------------------------------------------------- Jaccard join

def shingle_set(t):
    w = (t or "").lower().split()
    return {" ".join(w)} if 0 < len(w) < 5 else {" ".join(w[i:i + 5]) for i in range(len(w) - 4)}


def similar(a, b):
    return a == b or bool(a | b) and 5 * len(a & b) >= 4 * len(a | b)


def brute_links(rows):
    sets = [shingle_set(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and similar(sets[i], sets[j])] for i in range(len(rows))]
    out = []
    for i, (doc, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        same = [rows[j][0] for j in range(len(rows)) if sets[j] == sets[i]]
        known = [x for x in same if x is not None]
        out.append((doc, min(ids) if ids else None, min(known) if known else None, len(same), len(near[i])))
    return Counter(out)


@pytest.mark.parametrize("small", [1000, 2])
def test_links_match_brute_force(edges, small):
    got = jaccard_join.jaccard_links(edges, small=small)
    rows = Counter(tuple(r) for r in got.select("doc_id", "class_id", "text_id", "copies", "n_links").collect())
    assert rows == brute_links(edge_rows())


def test_large_group_of_near_copies_is_split_and_keeps_all_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 16)
    words = prose(300, 9).split()
    rows = [(i, " ".join(words[:i] + [f"own{i}"] + words[i + 1:])) for i in range(120)]
    rows += [(1000 + i, " ".join(words[:40]) + " " + prose(260, 100 + i)) for i in range(40)]  # a shared passage only
    got = jaccard_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"), small=8)
    assert Counter(tuple(r) for r in got.select("doc_id", "class_id", "text_id", "copies", "n_links").collect()) == brute_links(rows)


def test_one_row_of_each_group_stays_with_its_columns(edges, nothing):
    kept = jaccard_join.keep_one(edges)
    assert kept.columns == edges.columns
    rows = kept.collect()
    assert all(r["class_id"] == "old" and r["row"] == "old" for r in rows)
    ids = Counter(r["doc_id"] for r in rows)
    # -5 leads the near copies, 5 the texts without words, 8 its two spellings; one of the rows without an id has its own text.
    assert ids == Counter([-5, 4, 5, 8, 10, 11, 12, 13, 14, 15, None])
    assert jaccard_join.keep_one(nothing).count() == 0
    assert jaccard_join.jaccard_links(nothing).count() == 0


def test_runs_reach_the_recall():
    assert jaccard_join.runs_for(0.999, 1) == 7
    assert jaccard_join.runs_for(0.999, 3) > jaccard_join.runs_for(0.99, 3) > jaccard_join.runs_for(0.99, 1)


def test_sketch_bins_agree_as_the_sets_do():
    a, b = prose(400, 20).split(), None
    b = a[:380] + prose(20, 21).split()
    _, n, tokens = jaccard_join.profile([" ".join(a).encode(), " ".join(b).encode()])
    x, y = shingle_set(" ".join(a)), shingle_set(" ".join(b))
    assert abs((tokens[0] == tokens[1]).mean() - len(x & y) / len(x | y)) < 0.2
    assert list(n) == [len(x), len(y)]


# ------------------------------------------------------------ substring dedup

def brute_removal(rows, length=50):
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        for p in range(len(b) - length + 1):
            g = b[p:p + length]
            first[g] = min(first.get(g, (True, 0)), key(i))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < key(i):
                gone[p:p + length] = True
        gone = gone[:len(b)]
        spans = int(np.sum(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("batch_bytes", [4_000_000, 2_000])
def test_removed_bytes_match_brute_force(edges, batch_bytes):
    rows = [r for r in edge_rows() if r[0] != 11]
    got = substring_dedup.remove_repeats(edges.where("doc_id is null or doc_id <> 11"), batch_bytes=batch_bytes)
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    found = got.collect()
    assert Counter(tuple(r[c] for c in cols) for r in found) == brute_removal(rows)
    for r in found:
        assert sum(s["b"] - s["a"] for s in r["spans"]) == r["n_removed"] and len(r["spans"]) == r["n_spans"]


def test_windows_at_slice_and_document_ends(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE", 64)
    monkeypatch.setattr(substring_dedup, "PORTION", 50)
    text = prose(120, 31)
    rows = [(i, text[i * 13:i * 13 + 40 + 9 * i]) for i in range(25)] + [(99, text[:30])]
    b = [t.encode() for _, t in rows]
    buf, ends = np.frombuffer(b"".join(b), np.uint8), np.cumsum([len(x) for x in b])
    first, last, _ = substring_dedup.window_anchors(buf, ends, 50, 24)
    covered = np.concatenate([np.arange(x, y + 1) for x, y in zip(first, last)])
    want = [s + p for s, x in zip(ends - [len(x) for x in b], b) for p in range(len(x) - 49)]
    assert covered.tolist() == want
    size = last - first + 50
    start = np.cumsum(size) - size
    ctx = substring_dedup._expand(buf, first, size)
    doc = np.searchsorted(ends, first, side="right")
    masks = substring_dedup._held_earlier(ctx, start, size - 49, np.zeros(len(first), np.uint8), doc, 50)
    seen = {}
    for s, n, d in zip(first, size, doc):
        for p in range(s, s + n - 49):
            g = bytes(buf[p:p + 50])
            seen[g] = min(seen.get(g, d), d)
    assert [[bool(int(m) >> i & 1) for i in range(n - 49)] for m, n in zip(masks, size)] == \
        [[seen[bytes(buf[s + i:s + i + 50])] < d for i in range(n - 49)] for s, n, d in zip(first, size, doc)]


def test_run_index_joins_equal_bytes():
    text = np.frombuffer(b"abcdefgh" * 8 + b"zbcdefgh", np.uint8)
    start = np.arange(1, 57, 8)
    before = text[start - 1]
    index = substring_dedup.RunIndex(text, start, before, np.arange(len(start)), 8)
    assert len(index.run_head) == 1 and index.run_doc.tolist() == [0]
    assert index.earliest().tolist() == [0] * len(start)


def test_nothing_in_nothing_out(nothing):
    assert substring_dedup.remove_repeats(nothing).count() == 0


# --------------------------------------------------------------- secret scans

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_spans(t):
    t = t or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


SECRETS = [
    (1, "token=token: abcdefgh"), (2, "TOKEN = 'abcdef' api_key:x api-key=abcdefg APIKEY=\"a.b.c.d\""), (3, None), (4, ""),
    (5, "é" * 7 + " secret : zzzzzz " + "😀" + "AKIA" + "A" * 16 + " AKIA" + "A" * 15), (6, "f" * 24 + " " + "f" * 23 + "g" + "0" * 30),
    (7, "password=" + "ab12" * 10), (8, "a" * 100_000 + " passwd=hunter22"), (9, "Api_Key: '" + "0" * 40 + "'"), (9, "Api_Key: '" + "0" * 40 + "'"),
    (None, "secret=nullid"), (10, "token= \n abcdefgh"), (11, " ".join(f"token=abcdef{i}" for i in range(500))),
]


def test_spans_match_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in SECRETS], "doc_id long, text string, blob string, spans string")
    got = secret_scan.scan_versions(df, shared_path(spark, "test-ledger"))
    found = Counter((r["doc_id"], r["text"], tuple((s["start"], s["rank"], s["kind"], s["end"]) for s in r["spans"])) for r in got.collect())
    assert found == Counter((i, t, tuple(brute_spans(t))) for i, t in SECRETS)


def test_ledger_scans_only_unseen_pairs(spark):
    path = shared_path(spark, "test-ledger")
    df = spark.createDataFrame(SECRETS[:6], "doc_id long, text string")
    assert secret_scan.update_ledger(df, path) == 5 * 3  # null and empty are one blob
    assert secret_scan.update_ledger(df, path) == 0
    more = spark.createDataFrame(SECRETS[:7], "doc_id long, text string")
    assert secret_scan.update_ledger(more, path) == 3
    newer = (secret_scan.Rule("hex", r"([0-9a-f]{20,})", 1, 20, version=2), *secret_scan.BASE_RULES[:2])
    assert secret_scan.update_ledger(more, path, rules=newer) == 6
    found = secret_scan.blob_findings(spark, path, newer).where(F.exists("spans", lambda s: s["kind"] == "hex"))
    assert found.count() == 2
    assert secret_scan.update_ledger(df.limit(0), shared_path(spark, "test-ledger")) == 0


def test_redaction_keeps_rows_and_columns(spark, edges, nothing):
    df = spark.createDataFrame([(i, t, None if t is None else len(t), "old") for i, t in SECRETS],
                               "doc_id long, text string, n_chars int, blob string")
    rows = secret_scan.redact_secrets(df, shared_path(spark, "test-ledger"))
    assert rows.columns == df.columns
    want = []
    for i, t in SECRETS:
        spans, out, at = brute_spans(t), "", 0
        for s, _, _, e in spans:
            if s >= at:
                out, at = out + t[at:s] + "[SECRET]", e
            at = max(at, e)
        new = out + t[at:] if spans else t
        want.append((i, new, None if new is None else len(new), "old"))
    assert Counter(map(tuple, rows.collect())) == Counter(want)
    assert secret_scan.redact_secrets(edges, shared_path(spark, "test-ledger")).count() == edges.count()
    assert secret_scan.redact_secrets(nothing, shared_path(spark, "test-ledger")).count() == 0


def test_dotted_columns_are_scanned_and_kept(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh", "x"), (2, None, "y")], "doc_id long, `the.text` string, `a.b` string")
    found = secret_scan.scan_versions(docs, shared_path(spark, "test-ledger"), text="the.text")
    assert found.columns == ["doc_id", "the.text", "a.b", "blob", "spans"]
    assert {r["doc_id"]: (r["a.b"], len(r["spans"])) for r in found.collect()} == {1: ("x", 1), 2: ("y", 0)}
    clean = secret_scan.redact_secrets(docs, shared_path(spark, "test-ledger"), text="the.text")
    assert sorted(map(tuple, clean.collect())) == [(1, "[SECRET]", "x"), (2, None, "y")]


# ---------------------------------------------------------------- token store

def test_round_trip_matches_the_tokenizer(spark, edges, nothing):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    path = shared_path(spark, "test-tokens")
    token_store.write_shards(edges, path, tokenizer_path(), block_tokens=500)
    got = token_store.document_tokens(spark, path).collect()
    rows = sorted(edge_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [tok.encode(t or "", add_special_tokens=False).ids + [0] for _, t in rows]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(
        (d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, _), x in zip(rows, ids))
    at = 0  # in order of start the documents follow each other, nulls first
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    path = shared_path(spark, "test-tokens")
    token_store.write_shards(nothing, path, tokenizer_path())
    assert token_store.document_tokens(spark, path).count() == 0


@pytest.mark.parametrize("ids", [[], [7], [5] * 700, list(np.random.default_rng(1).integers(0, 50_000, 5000)), [3, 1, 2] * 600])
def test_wavelet_matrix_operations(ids):
    ids = np.array(ids, dtype=np.uint32)
    m = token_store.WaveletMatrix.build(ids)
    assert (m.decode() == ids).all()
    for i in range(0, len(ids), 97):
        assert m.access(i) == ids[i]
        assert m.rank(int(ids[i]), i) == int((ids[:i] == ids[i]).sum())
    for t in {int(x) for x in ids[:3]} | {49_999, 4}:
        assert m.occurrences(t) == np.flatnonzero(ids == t).tolist()
    assert m.select(60_000, 0) == -1


def test_pieces_give_the_same_ids():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    enc = token_store.Encoder(tokenizer_path())
    alphabet = ["a", "don't", "it's", "'s", "é", "日本", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "　", ".", ",", "!?",
                "12", "x9", "_", "😀", "<|endoftext|>", "'", '"', "\0", "Z"]
    rng = np.random.default_rng(3)
    texts = ["".join(alphabet[i] for i in rng.integers(0, len(alphabet), n)) for n in range(60) for _ in range(20)]
    got, per = enc.encode(texts, 0)
    assert [x.tolist() for x in np.split(got, np.cumsum(per)[:-1])] == \
        [tok.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_special_tokens_are_read_as_the_tokenizer_does(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    pick = ["a", "don't", "é", " ", "  ", "\n", "\n\n", "\t", "\xa0", ".", "12", "|", "<", "<|endoftext|>", "<|endoftext|", "|endoftext|>"]
    rng = np.random.default_rng(5)
    texts = ["end.<|endoftext|>Next", "<|endoftext|>", "<|endoftext|><|endoftext|>", "end.<|endof text|>Next"]
    texts += ["".join(pick[i] for i in rng.integers(0, len(pick), n)) for n in range(40) for _ in range(10)]
    want = [tok.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert want[0] == [437, 13, 50256, 10019, 0]
    got, per = token_store.Encoder(tokenizer_path(), special_as_text=False).encode(texts, 0)
    assert [x.tolist() for x in np.split(got, np.cumsum(per)[:-1])] == want
    path = shared_path(spark, "test-special")
    token_store.write_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, tokenizer_path())
    rows = sorted(token_store.document_tokens(spark, path).collect(), key=lambda r: r.doc_id)
    start = np.cumsum([0] + [len(x) for x in want])
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows] == [
        (i, start[i], len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(want)]


def thue_morse(n):
    """A word of n letters and the same with its two letters exchanged: equal in any polynomial hash modulo 2**64."""
    bits = [i.bit_count() % 2 for i in range(n)]
    return ["".join(pair[b] for b in bits) for pair in ("ab", "ba")]


def plain_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    return [tok.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_words_that_a_polynomial_hash_joins_stay_apart(spark):
    texts = [w for n in (1024, 2048, 8192) for w in thue_morse(n)] + [prose(50, 1)]
    got, per = token_store.Encoder(tokenizer_path(), special_as_text=False).encode(texts, 0)
    assert [x.tolist() for x in np.split(got, np.cumsum(per)[:-1])] == plain_ids(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = shared_path(spark, "test-tokens")
    token_store.write_shards(docs, path, tokenizer_path())
    rows = sorted(token_store.document_tokens(spark, path).collect(), key=lambda r: r.doc_id)
    assert [r.n_tokens for r in rows] == [len(x) for x in plain_ids(texts)]
    links = jaccard_join.jaccard_links(docs).collect()
    assert all(r["class_id"] == r["doc_id"] and r["copies"] == 1 and r["n_links"] == 0 for r in links)


def test_pieces_of_one_name_are_told_apart(monkeypatch):
    real = token_store.names
    monkeypatch.setattr(token_store, "names", lambda b, s, e, seed=0: real(b, s, e, seed) if seed else real(b, s, e) % np.uint64(5))
    texts = [prose(40, i) for i in range(30)]
    enc = token_store.Encoder(tokenizer_path(), special_as_text=False)
    for part in (texts[:10], texts):
        got, per = enc.encode(part, 0)
        assert [x.tolist() for x in np.split(got, np.cumsum(per)[:-1])] == plain_ids(part)


def test_names_differ_with_bytes_and_seed():
    rng = np.random.default_rng(2)
    spans = {bytes(rng.integers(0, 3, n).astype(np.uint8)) for n in [*range(1, 40)] * 40 + [5000, 5001] * 3}
    spans |= {b"\0" * n for n in range(1, 30)}
    spans = sorted(spans)
    size = np.array([len(x) for x in spans])
    buf = np.frombuffer(b"".join(spans), dtype=np.uint8)
    end = np.cumsum(size)
    a, b = names(buf, end - size, end), names(buf, end - size, end, 77)
    assert len(set(a.tolist())) == len(set(b.tolist())) == len(spans) and not (a == b).any()
    twice = np.concatenate([buf, buf])
    assert (names(twice, end - size + len(buf), end + len(buf)) == a).all()


# --------------------------------------------------------------- fingerprints

def test_next_documents_and_edited_texts(edges, nothing):
    got = fingerprint.nearest(edges.where("doc_id is not null")).collect()
    ids = {}
    for i, t in edge_rows():
        if i is not None:
            ids.setdefault(i, []).append(t or "")
    order = [(i, t) for i in sorted(ids, reverse=True) for t in ids[i]]
    want = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        new = t[:len(t) - cut] + following[:cut]
        a, b, c = fingerprint.sketches([t]), fingerprint.sketches([new]), fingerprint.sketches([following])
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprint.to_hex(a)[0], fingerprint.to_hex(b)[0],
                     fingerprint.likeness(a, b)[0], fingerprint.likeness(a, c)[0]))
    assert Counter(map(tuple, got)) == Counter(want)
    assert fingerprint.nearest(edges).count() == edges.count()
    assert fingerprint.nearest(nothing).count() == 0
    alone = fingerprint.nearest(edges.where("doc_id = 4")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_equal_texts_have_equal_fingerprints_in_any_batch(edges):
    by = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(edges).where("doc_id is not null").collect()}
    assert by[1] == by[3] and by[2] == by[-5] and by[5] == by[6] and by[1] != by[4]


def test_equal_substrings_share_inner_phrases():
    inner = prose(400, 40)
    a, b = prose(37, 41) + inner, inner + prose(90, 42)
    for level in (1, 2, 3):
        names = []
        for t in (inner, a, b):
            x = np.array([ord(c) for c in t], dtype=np.uint64)
            own = np.zeros(len(x), dtype=np.int64)
            for _ in range(level):
                x, own = fingerprint.parse_level(x, own)
            names.append(list(x))
        middle = names[0][6:-6]  # all but a few phrases at the ends
        for whole in names[1:]:
            k = whole.index(middle[0])
            while whole[k:k + len(middle)] != middle:
                k = whole.index(middle[0], k + 1)


def test_likeness_falls_with_the_shared_part():
    t = prose(600, 50)
    s = fingerprint.sketches([t, t[:2 * len(t) // 3] + prose(300, 51)[:len(t) // 3], prose(600, 52), ""])
    near = [fingerprint.likeness(s[:1], s[i:i + 1])[0] for i in range(4)]
    assert near[0] == 1 and 0.3 < near[1] < 0.8 and near[2] < 0.1 and near[3] == 0
    assert fingerprint.likeness(s[3:], s[3:])[0] == 1


FULL = (1 << 64) - 1


def plain_mix(x):
    """The splitmix finaliser, on Python integers."""
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & FULL
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & FULL
    return x ^ x >> 31


def plain_toss(before, at):
    low = next((b for b in range(63) if (before ^ at) >> b & 1), 63)
    return 2 * low + (at >> low & 1)


def plain_level(symbols):
    """One level's phrase names, symbol by symbol."""
    golden = 0x9E3779B97F4A7C15
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    joined = [s if n == 1 else plain_mix((s + n * golden) & FULL) for s, n in runs]
    labels = [plain_toss(b, a) for b, a in zip([FULL, *joined], joined)]
    for _ in range(3):
        labels = [plain_toss(b, a) for b, a in zip([254, *labels], labels)]
    phrases = []
    for i, s in enumerate(joined):
        peak = 0 < i < len(joined) - 1 and labels[i - 1] < labels[i] > labels[i + 1]
        if i == 0 or peak:
            phrases.append([])
        phrases[-1].append(s)
    return [plain_mix(sum(plain_mix((s + (j + 1) * golden) & FULL) for j, s in enumerate(ph)) & FULL) for ph in phrases]


def plain_fingerprint(text):
    symbols, slots = [ord(c) for c in text], {}
    for level in range(1, 5):
        symbols = plain_level(symbols)
        for name in symbols if level >= 2 else []:
            h = plain_mix(name ^ level)
            slot, rank = (level, h >> 59), h >> 20 & 0xFFFFFFFF
            slots[slot] = min(slots.get(slot, rank), rank)
    return {k: plain_mix(v) % 65535 + 1 for k, v in slots.items()}


def plain_likeness(a, b):
    shares = []
    for level in (2, 3, 4):
        filled = [k for k in a.keys() | b.keys() if k[0] == level]
        if filled:
            shares.append(sum(a.get(k) == b.get(k) for k in filled) / len(filled))
    return sum(shares) / len(shares) if shares else 1.0


def test_fingerprints_match_a_plain_twin(spark):
    """Whole query rows against a twin that shares no code with the module: runs, edges, long and odd texts."""
    texts = {1: prose(80, 60), 2: "", 3: None, 4: "a", 5: "aab" * 300, 6: "z" * 2000, 7: "\U0001f600\u00e9 " * 90,
             8: prose(3000, 61), 9: prose(80, 60), 10: "ab", 12: "abc" + prose(200, 62), 40: " "}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    order = sorted(texts, reverse=True)
    want = {}
    for i, nxt in zip(order, [*order[1:], order[0]]):
        t, f = texts[i] or "", texts[nxt] or ""
        third = len(t) // 3
        new = t[:len(t) - third] + f[:third]
        a, b, c = plain_fingerprint(t), plain_fingerprint(new), plain_fingerprint(f)
        hexed = ["".join(f"{x.get((level, k), 0):04x}" for level in (2, 3, 4) for k in range(32)) for x in (a, b)]
        want[i] = (len(t), hashlib.sha256(new.encode()).hexdigest(), *hexed, plain_likeness(a, b), plain_likeness(a, c))
    got = {r["doc_id"]: tuple(r)[1:7] for r in fingerprint.nearest(docs).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:4] == want[i][:4], i
        assert got[i][4:] == pytest.approx(want[i][4:], abs=1e-12)
