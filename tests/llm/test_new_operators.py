"""Operators 11 to 13 against brute force: nulls, ties, repeated rows, empty and long texts, clashing columns."""

from __future__ import annotations

import base64
import collections
import hashlib
import io
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from attestry.llm import merkle, ranking, store, warc

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# ------------------------------------------------------------------ 11 ranked search
def terms(text: str | None) -> list[str]:
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(items, documents, k: int = 20) -> collections.Counter:
    docs = [(i, terms(t)) for i, t in documents]
    n, total = sum(1 for _, w in docs if w), sum(len(w) for _, w in docs)
    df = collections.Counter(x for _, w in docs for x in set(w))
    out: collections.Counter = collections.Counter()
    for item, text in items:
        score: collections.Counter = collections.Counter()
        for x in terms(text):
            weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1)))
            for j, (_, w) in enumerate(docs):
                if tf := w.count(x):
                    score[j] += weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(w) * n) // total)))
        best = sorted((-s, docs[j][0] is None, docs[j][0] or 0) for j, s in score.items() if s > 0)[:k]
        out.update((item, r, None if absent else i, -s) for r, (s, absent, i) in enumerate(best, 1))
    return out


@pytest.fixture(scope="module")
def searched(spark):
    r = random.Random(1)
    known = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 4))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(known[: int(3 + 297 * r.random() ** 3)]) for _ in range(n)).title()
    twice = text(20)
    docs = [(i, text(r.randrange(1, 50))) for i in range(260)]
    docs += [(None, None), (5, ""), (6, " .,\n"), (None, "ab abc"), (7, twice), (7, twice), (8, twice), (99, text(5000))] + [(3000 + i, "same text abc") for i in range(40)]
    items = [(i, text(r.randrange(1, 40))) for i in range(25)] + [(None, "abc"), (3, "abc same"), (3, "abc same"), (71, None), (72, ""), (73, "unheard"), (74, text(1500))]
    return items, docs


@pytest.mark.parametrize("group", [1 << 20, 6000])
def test_ranked_search(spark, searched, monkeypatch, group):
    monkeypatch.setattr(ranking, "GROUP_BYTES", group)  # the smaller one makes several passes
    items, docs = searched
    left = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, rank string").repartition(2)
    right = spark.createDataFrame([(*x, "x", 1) for x in docs], "doc_id long, text string, score string, item long").repartition(3)
    got = collections.Counter(tuple(x) for x in ranking.ranked_search(left, right).collect())
    assert got == ranked(items, docs)


def test_ranked_search_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string, doc_id long")
    some = spark.createDataFrame([(1, "a", 1)], "item_id long, text string, doc_id long")
    assert ranking.ranked_search(none, some).count() == 0 and ranking.ranked_search(some, none).count() == 0


def test_trees_leave_pairs_out():
    import numpy as np

    r = np.random.default_rng(2)
    topics = r.random((8, 400)) < 0.02
    docs = (topics[r.integers(0, 8, 1000)] & (r.random((1000, 400)) < 0.7)) * r.integers(1, 1000, (1000, 400)).astype(float)
    items = (topics[r.integers(0, 8, 64)] & (r.random((64, 400)) < 0.9)) * r.integers(1, 50, (64, 400)).astype(float)
    best = ranking.Best(64, 5)
    ones = np.ones(400)
    scored = sum(ranking.search(ranking.Tree.over(items, ones), ranking.Tree.over(docs[k : k + 250], ones), best, np.arange(k, k + 250), np.zeros(250, bool)) for k in range(0, 1000, 250))
    exact = docs @ items.T
    for j in range(64):
        want = sorted(((-s, i) for i, s in enumerate(exact[:, j]) if s > 0))[:5]
        assert [(-s, i) for s, i in zip(best.score[j, : best.n[j]], best.id[j])] == want
    assert scored < 0.35 * exact.size


# ------------------------------------------------------------------ 12 WARC
@pytest.mark.parametrize("least", [0, 6])
def test_archives(spark, least):
    r = random.Random(1)
    rows = [
        (r.choice([None, r.randrange(-50, 90)]), r.choice(["http://a/", None, "http://b/\r\nx"]), r.choice([None, "", "x", "é" * 5, "y" * 1000, "z%d" % r.randrange(50), "long%d" % r.randrange(9) * 2000]))
        for _ in range(150)
    ]
    rows += [rows[0]] * 300
    pages = spark.createDataFrame([(*x, "c", 1) for x in rows], "page_id long, url string, html string, record_type string, payload long").repartition(3)
    folder = store.shared(spark, "archive")
    manifest = warc.archive_pages(pages, folder, least=least, segment_bytes=1000, file_bytes=20000)
    records = warc.read_records(manifest, folder)
    assert records.where("record_type = 'continuation'").count() > 50
    decoded = warc.reassemble(records)
    found = warc.resolved(decoded).collect()
    assert not any(x.problem for x in found)
    rank = lambda i: (i is not None, i or 0)
    best = {h or "": max(rank(j) for j, _, g in rows if (g or "") == (h or "")) for _, _, h in rows}
    want, seen = collections.Counter(), set()
    for i, _, h in rows:
        body = (h or "").encode()
        response = len(body) < least or (best[h or ""] == rank(i) and h not in seen and (h or "") not in seen)
        if response and len(body) >= least:
            seen.add(h or "")
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want[(i, len(body), digest, *(("response", None) if response else ("revisit", best[h or ""][1] if best[h or ""][0] else None)))] += 1
    assert collections.Counter((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in found) == want
    bodies = {(x.page_id, x.payload.decode()) for x in decoded.where("record_type = 'response'").collect()}
    assert all((i, h or "") in bodies for i, _, h in rows if rank(i) == best[h or ""])


def test_empty_archive(spark):
    folder = store.shared(spark, "archive")
    manifest = warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert manifest.count() == 0 and warc.resolved(warc.reassemble(warc.read_records(manifest, folder))).count() == 0


def test_segments_in_any_order_and_broken_ones(spark):
    payload = b"abcdefghij" * 500
    cut = lambda key: list(warc.segments([("WARC-Type", "response"), ("Content-Type", "application/http; msgtype=response")], key, 0, warc.HTTP + warc.framed(payload, 300), 700))
    read = lambda pieces: list(warc.parsed(io.BufferedReader(io.BytesIO(b"".join(pieces)))))
    good, lost, short = cut("good"), cut("lost"), cut("short")
    del lost[3], short[-1]
    rows = []
    for fields, block, problem in read(good[::-1] + good[2:4] + lost + short):
        origin, number = fields.get("warc-segment-origin-id"), int(fields["warc-segment-number"])
        rows.append((fields["warc-record-id"], fields["warc-type"], None, None, None, None, fields.get("content-type"), origin, number, int(n) if (n := fields.get("warc-segment-total-length")) else None, block, problem))
    got = {x.record_id: x for x in warc.reassemble(spark.createDataFrame(rows, warc.RECORD).repartition(4)).collect()}
    whole = got[warc._urn("good", 0)]
    assert bytes(whole.payload) == payload and whole.problem is None and whole.record_type == "response"
    assert got[warc._urn("lost", 0)].problem == "segment missing" and got[warc._urn("short", 0)].problem == "last segment missing"
    assert len(got) == 3
    assert read([good[0][:-30]])[-1][2] == "cut off" and read([b"no archive"])[-1][2] == "no WARC record"
    changed = good[0].replace(b"abc", b"abd", 1)
    assert read([changed])[0][2] == "block digest differs"


def test_chunk_framing():
    for n in (0, 1, 299, 300, 301, 5000):
        assert warc.unframed(warc.framed(b"x" * n, 300)) == b"x" * n
    assert warc.unframed(b"3;ext=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for broken in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\nabc\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            warc.unframed(broken)


# ------------------------------------------------------------------ 13 Merkle manifest
def hexed(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row) -> str:
    return hexed(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([hexed(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def proofs(rows) -> list[tuple]:
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    held = {g: sorted(groups[g], key=lambda x: x[:3]) for g in names}
    trees = {g: levels([x[2] for x in held[g]]) for g in names}
    top, out = levels([trees[g][-1][0] for g in names]), []
    for k, g in enumerate(names):
        for place, (_, _, leaf, row) in enumerate(held[g]):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            node, found = leaf_of((*row[:3], row[3] + 1, row[4])) if tampered else leaf, []
            for tree, at in ((trees[g], place), (top, k)):
                for level in tree[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else ""
                    found.append(other)
                    node = hexed(other, node) if at % 2 else hexed(node, other)
                    at //= 2
            out.append((row[0], leaf, trees[g][-1][0], top[-1][0], hexed(*found), node, node == top[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, g string, at long"


def manifest_of(spark, rows) -> list[tuple]:
    documents = spark.createDataFrame([(*x, "c", "c", 1) for x in rows], SCHEMA).repartition(3)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = merkle.build_manifest(documents, changed={"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}).proofs()
    return sorted([tuple(x) for x in made.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=str)


def test_manifest_with_ties_and_repeats(spark):
    r = random.Random(1)
    rows = [
        (
            r.choice([None, r.randrange(-50, 400), r.randrange(-1 << 62, 1 << 62), -(1 << 63), (1 << 63) - 1]),
            r.choice(["a", None, ""]),
            r.choice(["en"] * 9 + [None, "", "de", "fr", "ä"]),
            r.choice([None, 5, 7]),
            r.choice(["x", "", None, "é" * 5, "y" * 50000]),
        )
        for _ in range(900)
    ]
    rows += [rows[0]] * 300
    assert manifest_of(spark, rows) == proofs(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 257])
def test_manifest_of_few_leaves(spark, n):
    rows = [(i * 3, "s", ["en", "de"][i % 2] if n > 2 else None, i, "t") for i in range(n)]
    assert manifest_of(spark, rows) == (proofs(rows) if rows else [])
