"""Every operator against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from attestry.llm import chat, decontaminate, jaccard, packing, quality, rollups, sharding, substring, tokens, urls
from attestry.llm.components import components

LETTERS = "abcdefghijkl"


def word(r: random.Random) -> str:
    return "".join(r.choice(LETTERS) for _ in range(r.randint(1, 6))) + r.choice(["", "", "", ".", "é", "!"])


def prose(r: random.Random, n: int) -> str:
    return "".join(word(r) + r.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(n))


def edited(r: random.Random, text: str, k: int) -> str:
    parts = text.split(" ")
    for _ in range(k):
        parts[r.randrange(len(parts))] = word(r)
    return " ".join(parts)


def corpus(seed: int = 3) -> list[tuple[int | None, str | None]]:
    r = random.Random(seed)
    base = [prose(r, r.randint(1, 160)) for _ in range(60)]
    near = [edited(r, r.choice(base), r.randint(0, 6)) for _ in range(120)]
    group = prose(r, 120)
    near += [edited(r, group, r.randint(0, 9)) for _ in range(60)]  # many near copies of one text
    passage = prose(r, 70)
    shared = [prose(r, 40) + passage + prose(r, 30) for _ in range(12)]
    odd = [None, "", " \n\t", "one", "one", "One two three", "ONE two three", prose(r, 9000), "a b c d", "a b c d e"]
    rows = list(enumerate(base + near + shared + odd))
    rows += [rows[5], rows[5], (None, base[3]), (None, None), (9000, base[7])]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    made = [(i, t, "x", 1, True) for i, t in corpus()]
    return spark.createDataFrame(made, "doc_id long, text string, kept string, n_words int, node boolean").repartition(3).cache()


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def spaced(s: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


# ------------------------------------------------------------------ components
def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {v: v for e in edges for v in e}
    for _ in range(100):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert got == {v: m for v, m in least.items() if any(v in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ 1 packing
@pytest.mark.parametrize("seed", range(4))
def test_pack_fills_bins_without_overlap(seed):
    r = random.Random(seed)
    sizes = [16, 64, 128]
    lengths = [min(128, int(r.paretovariate(0.8))) for _ in range(500)]
    chosen, offset, final, used = packing.pack(lengths, sizes)
    by = collections.defaultdict(list)
    for n, b, o in zip(lengths, chosen, offset):
        by[b].append((o, n))
    for b, held in by.items():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at == used[b] and final[b] == min(s for s in sizes if s >= at)
    assert sum(used) / sum(final) > 0.9
    assert packing.pack([], sizes) == ([], [], [], [])


def test_pack_documents_covers_every_token(spark, docs):
    got = packing.pack_documents(docs, sizes=(32, 128, 512), group=100).collect()
    spans = collections.Counter()
    for row in got:
        assert 0 <= row.start and row.start + row.n <= row.bin_used <= row.bin_size
        spans[row.id] += row.n
    want = collections.Counter()
    for i, t in corpus():
        want[i] += len(spaced(t)) + 1
    assert spans == want
    for _, rows in itertools.groupby(sorted(got, key=lambda x: (x.bin, x.start)), key=lambda x: x.bin):
        at = 0
        for row in rows:
            assert row.start == at
            at += row.n
    assert packing.pack_documents(spark.createDataFrame([], EMPTY)).count() == 0


# ------------------------------------------------------------------ 2 quality rules
def test_counts_of_texts(docs):
    got = collections.Counter(tuple(r) for r in quality.judge(docs, quality.Model((), ())).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect())
    want = collections.Counter()
    for _, t in corpus():
        s = t or ""
        w = spaced(s)
        windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeat = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in s.split("\n"):
            if spaced(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
        want[(t, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", s)), dup, len(repeat), failed, not failed)] += 1
    assert got == want


def test_decision_list_on_held_out_rows(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        kind = r.choice(["good", "good", "loud", "rude"])
        text = prose(r, 90)
        if kind == "loud":
            text = text.upper()
        if kind == "rude":
            text = " ".join(w if r.random() > 0.05 else "blockhead" for w in text.split(" "))
        rows.append((i, text, kind == "good" or (kind == "rude" and "blockhead" not in text)))
        if i < 400:
            labels.append((i, 0 if kind == "loud" else 1, int(not rows[-1][2] and kind == "rude")))
    documents = spark.createDataFrame(rows, "doc_id long, text string, good boolean")
    model = quality.fit(documents, spark.createDataFrame(labels + [(None, 0, 0), (5000, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int"))
    assert "blockhead" in model.lexicon and model.rules
    held = [x for x in quality.judge(documents, model).collect() if x.doc_id >= 400 and not x.base_failed]
    assert sum(x.kept == x.good for x in held) / len(held) > 0.97


def test_no_labels_and_no_documents(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, none)
    assert model == quality.Model((), ())
    assert quality.keep_good(spark.createDataFrame([], EMPTY), none).columns == ["doc_id", "text", "lang", "source", "n_chars"]


# ------------------------------------------------------------------ 3 url filters
def parts(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_url_rules_and_models(spark):
    r = random.Random(4)
    urls_ = [None, "", "nonsense", "http://", "https://COM/", "http://com", "http://www.example.com/en/1", "http://a.www.example.com/en/", "http://example.com/en", "http://net/fr/x?y", "http://a.net?/es/"]
    for i in range(400):
        good = r.random() < 0.5
        host = "".join(r.choice("abcde" if good else "vwxyz") for _ in range(8))
        urls_.append(f"https://{host}.{r.choice(['com', 'org', 'org']) if good else r.choice(['net', 'org', 'org'])}/{'de' if good else 'fr'}/{r.randrange(1000)}")
    rows = [(i, u, "x") for i, u in enumerate(urls_)] + [(0, None, "x"), (None, urls_[20], "x")]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    known = {i: u for i, u, _ in rows}
    right = []
    for row in got:
        url = known[row.id]
        host, path = parts(url)
        assert (row.host, row.path) == (host, path)
        fits = [x for x in urls.RULES if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: len(x[0]) + len(x[1]), default=None)
        assert row.rule == (best and best[0] + best[1])
        if best:
            assert row.verdict == best[2]
        elif host.endswith(".org"):
            right.append(row.verdict == ("allow" if set(host[:-4]) <= set("abcde") else "block"))
    assert len(right) > 100 and sum(right) / len(right) > 0.97
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    alone = urls.filter_urls(spark.createDataFrame([(1, "x://a.org/")], "page_id long, url string")).collect()
    assert alone[0].verdict == "allow"


def test_model_probabilities_by_hand(spark):
    seen = [("^ab$", True, 3), ("^aa$", False, 2), ("^b$", False, 1), ("^a/es/x9É$", False, 2), ("^a/es/x8é$", True, 1)]
    got = {r.gram: r.ratio for r in urls.train(spark.createDataFrame(seen, "chars string, accepted boolean, weight long")).collect()}
    import math

    def p(gram: str, side: bool) -> float:
        if not gram:
            return 1 / (len({c for chars, _, _ in seen for c in chars[1:]}) + 1)
        grams = collections.Counter()
        for chars, s, w in seen:
            if s == side:
                for i in range(1, len(chars)):
                    part = chars[max(0, i - urls.ORDER + 1) : i + 1][-len(gram) :]
                    if len(part) == len(gram):
                        grams[part] += w
        of = {g: n for g, n in grams.items() if g[:-1] == gram[:-1]}
        c, t, q = sum(of.values()), len(of), p(gram[1:], side)
        return (grams[gram] + t * q) / (c + t) if c else q

    assert max(map(len, got)) == urls.ORDER and all(abs(v - math.log(p(g, True)) + math.log(p(g, False))) < 1e-9 for g, v in got.items())
    texts_ = spark.createDataFrame([("^a/es/x7$",), ("^zz$",), ("^ab$",)], "chars string")
    scores = {r.chars: r.score for r in urls.score(texts_, urls.train(spark.createDataFrame(seen, "chars string, accepted boolean, weight long"))).collect()}
    for chars, value in scores.items():
        places = [next((got[chars[i - n : i + 1]] for n in range(min(i, urls.ORDER - 1), -1, -1) if chars[i - n : i + 1] in got), 0.0) for i in range(1, len(chars))]
        assert abs(value - sum(places) / len(places)) < 1e-9


# ------------------------------------------------------------------ 4 n-gram Jaccard join
def shingle_sets(size: int = 5) -> list[tuple[int | None, frozenset]]:
    out = []
    for i, t in corpus():
        w = spaced(lower(t or ""))
        out.append((i, frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()))
    return out


@pytest.mark.parametrize(("percent", "frequent_from"), [(80, 32), (80, 2), (60, 4)])
def test_similarity_classes(spark, docs, percent, frequent_from, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 7)
    got = collections.Counter(tuple(r) for r in jaccard.similarity_classes(docs, percent=percent, frequent_from=frequent_from).collect())
    sets = shingle_sets()
    label = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= percent * len(x | y) and label[a] != label[b]:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if v == old else v for v in label]
    least: dict = {}
    for (i, s), v in zip(sets, label):
        if i is not None:
            least[v] = min(least.get(v, i), i)
    want = collections.Counter((i, len(s), least.get(v) if s else i) for (i, s), v in zip(sets, label))
    assert got == want


def test_keep_one_each(spark, docs):
    classes = {r.component_id for r in jaccard.similarity_classes(docs).collect() if r.component_id is not None}
    kept = jaccard.keep_one_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(classes) and ids.count(None) == 2
    assert jaccard.similarity_classes(spark.createDataFrame([], EMPTY)).count() == 0


# ------------------------------------------------------------------ 5 sharding
def test_shards(spark, docs):
    rows, slot_map = sharding.shard_documents(docs, shards=5)
    got = rows.collect()
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in corpus())
    assert collections.Counter((r.id, r.size, r.text_crc32) for r in got) == want
    load = collections.Counter()
    slots = collections.defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r.size for r in got)
    assert max(load.values()) - min(load.values()) <= largest
    known = dict(corpus())
    homes = collections.defaultdict(set)
    for r in got:
        if r.id is not None:
            homes[known[r.id] or ""].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())  # equal texts stay together
    assert {r.version for r in slot_map.collect()} == {1, 2}
    assert sharding.shard_documents(spark.createDataFrame([], EMPTY))[0].count() == 0


def test_one_text_of_most_rows_is_parted(spark):
    rows, _ = sharding.shard_documents(spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}") for i in range(900)], "doc_id long, text string"), shards=4)
    load = collections.Counter()
    for r in rows.collect():
        load[r.shard] += r.size
    assert len(load) == 4 and max(load.values()) - min(load.values()) < 0.2 * max(load.values())


def test_rebalancing_moves_slots_to_the_new_shard():
    units = [(s, 0, 100 + s % 7, s % 4) for s in range(400)]
    grown = sharding.rebalanced(units, 5)
    moved = [(a[3], b[3]) for a, b in zip(units, grown) if a[3] != b[3]]
    load = collections.Counter()
    for u in grown:
        load[u[3]] += u[2]
    assert sum(b == 4 for _, b in moved) > 0.85 * len(moved) and len(moved) < 120 and max(load.values()) - min(load.values()) < 110


# ------------------------------------------------------------------ 6 token files
def test_token_files_round_trip(spark, docs, tmp_path):
    vocabulary = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    extra = [(70001, "a  b\n\n c <|endoftext|> d"), (70002, "tail "), (70003, " lead\u00a0x \u2003y"), (70004, "don't  I'll\n x")]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    manifest = tokens.write_token_files(more, str(tmp_path), vocabulary)
    got = tokens.read_token_files(manifest, str(tmp_path), "ids_crc32 long", tokens.checksum).collect()
    model = Tokenizer.from_file(vocabulary)
    at, want = 0, collections.Counter()
    for i, t in sorted(corpus() + extra, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = model.encode(t or "", add_special_tokens=False).ids + [0]
        want[(i, at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))] += 1
        at += len(ids)
    ordered = lambda c: sorted((x for x in c.elements() if x[0] is not None))
    assert ordered(collections.Counter(tuple(r) for r in got)) == ordered(want)
    assert sum(r.n_tokens for r in got) == at
    assert tokens.write_token_files(spark.createDataFrame([], EMPTY), str(tmp_path / "none"), vocabulary).agg({"docs": "sum"}).first()[0] in (0, None)


# ------------------------------------------------------------------ 7 substring dedup
def test_bands_reach_the_recall():
    for recall in (0.9, 0.98, 0.999):
        bands, rows = substring.tune_bands(0.8, recall)
        assert 1 - (1 - 0.8**rows) ** (bands * 2) >= recall


def test_repeated_passages(spark):
    r = random.Random(8)
    plain = lambda n: " ".join(word(r) for _ in range(n))
    passage, rows, clean = plain(60), [], []
    for i in range(40):
        rows.append((i, plain(80) + " " + passage + "\n" + plain(50)))
    for i in range(40, 80):
        clean.append(i)
        rows.append((i, plain(150)))
    rows.append((90, edited(r, passage, 1)))  # one word changed
    rows += [(91, None), (92, ""), (None, passage), (93, plain(9)), (94, passage), (94, passage)]
    documents = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, id string").repartition(4)
    got = substring.repeated_passages(documents).collect()
    assert {x.id for x in got} == {*range(1, 40), 90, 94} and {x.component_id for x in got} == {0}
    for x in got:
        if x.id < 40:
            assert (x.first, x.last) == (80, 139)
    left = substring.remove_repeats(documents)
    assert left.columns == documents.columns
    text = collections.defaultdict(list)
    for x in left.collect():
        text[x.doc_id].append(x.text)
    assert passage in text[0][0] and not any(passage in t for i in range(1, 40) for t in text[i])
    assert 94 not in text and text[None] == [passage] and text[91] == [None] and text[92] == [""]
    known = dict(rows)
    assert all(text[i] == [known[i]] for i in clean)
    assert all(len(text[i][0].split()) == 130 for i in range(1, 40))
    assert substring.repeated_passages(spark.createDataFrame([], EMPTY)).count() == 0


def shingled(*texts_: list[int]) -> list[np.ndarray]:
    return [np.array([zlib.crc32(repr(t[i : i + 5]).encode()) for i in range(len(t) - 4)], np.uint32) for t in texts_]


def test_spans_have_a_counterpart():
    spans = lambda a, b: substring.common_spans(*shingled(a, b), 5, 50, 0.8)
    w = list(range(10000))
    apart = w[:26] + w[1000:1200] + w[26:52]
    assert spans(apart, w[2000:2100] + w[:52]) == []  # two lines that are neighbours in b only
    assert spans(w[26:52] + w[1000:1200] + w[:26], w[:52]) == []
    assert spans(w[1000:1200] + w[:60], w[:60]) == [(0, 59)]
    one = w[:30] + [-1] + w[31:60]
    assert spans(w[500:600] + w[:60], one) == [(0, 59)] and spans(w[500:600] + w[:60] + w[700:], w[:30] + w[31:60]) == [(0, 58)]
    # A chain below the bar has a part at the bar: 60 words with one change, then a change every 7 words.
    tail = [x if k % 7 else -2 - k for k, x in enumerate(w[60:130])]
    assert [x for x in spans(w[:130], one + tail) if x[0] == 0 and 59 <= x[1] < 80]
    # The same passage several times, runs of one word, and long texts that repeat themselves.
    assert spans(w[:60] + w[200:300] + w[:60], one) == [(0, 59)]
    assert spans([7] * 3000, [7] * 2000) == [(0, 1999)] and spans(w[:9] * 500, w[:9] * 400) == [(0, 3599)]
    assert spans([], w[:60]) == [] and spans(w[:40], w[:40]) == []


@pytest.mark.parametrize("n", [50, 51, 60, 70, 120])
def test_near_passages_share_a_band(n):
    """Recall of the bands as ``repeated_passages`` takes them, of near passages that verification finds."""
    r = random.Random(n)
    fresh = lambda k: [r.randrange(1 << 40) for _ in range(k)]
    found = wanted = 0
    for trial in range(300):
        passage = fresh(n)
        other = list(passage)
        for _ in range(1 if n < 90 else 2):
            k = n // 2 + r.randrange(-4, 5) if trial % 3 == 0 else r.randrange(len(other))
            other[k : k + r.randrange(2)] = fresh(r.randrange(2)) or other[k : k + 1]
        sides = [fresh(40) + passage + fresh(40), fresh(30) + other + fresh(50)]
        if substring.common_spans(*shingled(*sides), 5, 50, 0.8):
            bounds = np.array([0, len(sides[0]), len(sides[0]) + len(sides[1])])
            hashes = substring.texts.mix(np.array(sides[0] + sides[1], np.uint64))
            bands, rows = substring.bands_of(5, 50, 0.8, 0.98, substring.PARAGRAPH, substring.SPREAD)
            keys, of = substring.band_keys(hashes, bounds, bands, rows, 5, substring.PARAGRAPH, substring.SPREAD)[:2]
            wanted += 1
            found += bool(set(keys[of == 0].tolist()) & set(keys[of == 1].tolist()))
    assert wanted > 100 and found >= 0.98 * wanted, (found, wanted)


def test_passages_around_a_line_that_the_first_document_has(spark):
    r = random.Random(9)
    fresh = lambda n: " ".join(f"w{r.randrange(1 << 40)}" for _ in range(n))
    rows = []
    for g in range(0, 300, 10):  # 44 words in document g, 52 around them in the three after it
        line, before, after = fresh(44), fresh(4), fresh(4)
        rows.append((g, f"{fresh(30)} {line} {fresh(20)}"))
        rows += [(g + k, f"{fresh(7 * k)} {before} {line} {after} {fresh(20)}") for k in (1, 2, 3)]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(x.id, x.first, x.last) for x in got} == {(g + k, 7 * k, 7 * k + 51) for g in range(0, 300, 10) for k in (2, 3)}
    assert all(x.keeper_id % 10 and x.component_id == x.id // 10 * 10 + 1 for x in got)


def test_near_copies_around_a_line_that_the_first_document_has(spark):
    """Copies with an edit in each 50 words, of whose paragraphs the first document has all: every pair at the bar is cut and linked."""
    r = random.Random(13)
    fresh = lambda n: " ".join(f"w{r.randrange(1 << 40)}" for _ in range(n))
    rows = []
    for g in range(0, 300, 10):  # 44 words, another word in each copy, 8 words; document g has the 44 words or 42 of them
        line, tail = fresh(44), fresh(8)
        rows.append((g, f"{fresh(30)} {line if g % 20 else ' '.join(line.split()[1:-1])} {fresh(20)}"))
        rows += [(g + k, f"{fresh(7 * k)} {line} {fresh(1)} {tail} {fresh(20)}") for k in (1, 2, 3)]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(x.id, x.first, x.last) for x in got} == {(g + k, 7 * k, 7 * k + 52) for g in range(0, 300, 10) for k in (2, 3)}
    assert all(x.keeper_id % 10 and x.keeper_id < x.id and x.component_id == x.id // 10 * 10 + 1 for x in got)


def test_links_of_what_is_cut_already(spark):
    """A copy of a passage of which two others have a part: it is linked with both, though one keeper is enough to cut it."""
    r = random.Random(14)
    fresh = lambda n: [f"w{r.randrange(1 << 40)}" for _ in range(n)]
    middle = fresh(60)
    one, other = list(middle), list(middle)
    one[5:9], other[51:55] = fresh(4), fresh(4)
    more, last = fresh(60), fresh(60)
    rows = [(0, more), (1, one[9:] + last), (2, other[:51] + fresh(30) + more), (3, fresh(10) + middle + fresh(10)), (4, fresh(5) + last)]
    got = substring.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert {x.id for x in got} == {2, 3, 4} and {x.component_id for x in got} == {0}
    edges = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if substring.common_spans(*shingled(x, y), 5, 50, 0.8)}
    assert edges == {(0, 2), (1, 3), (1, 4), (2, 3)}


def test_a_common_line_makes_no_pairs_of_all(spark, monkeypatch):
    """Documents that have 40 words in common and nothing else: what is stored grows with them and not with their square."""
    r = random.Random(21)
    fresh = lambda n: " ".join(f"w{r.randrange(1 << 40)}" for _ in range(n))
    line, made, stored = fresh(40), [], substring.store.stored

    def counted(df, name):
        out = stored(df, name)
        made[-1][name] = max(made[-1].get(name, 0), out.count())
        return out

    monkeypatch.setattr(substring.store, "stored", counted)
    for n in (40, 160):
        rows = [(0, f"{fresh(30)} {' '.join(line.split()[1:-1])} {fresh(30)}")]
        rows += [(k, f"{fresh(30)} {line} {fresh(30)}") for k in range(1, n)]
        made.append({})
        assert substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    assert made[1]["keys"] > 3 * made[0]["keys"]
    assert all(made[1][name] <= 6 * max(rows, 40) for name, rows in made[0].items()), made


def test_rows_of_a_batch_leave_in_bounded_batches():
    """Documents whose places make many rows: a worker holds some documents' rows and not those of the whole batch."""
    rng = np.random.default_rng(5)
    shingles = [rng.integers(0, 1 << 32, 400, dtype=np.uint32).tobytes() for _ in range(200)]
    spans = pa.array([None] * 200, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
    places = pa.array([list(range(60, 340, 20))] * 200, pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([0] * 200, pa.int32()), pa.array(range(200)), pa.array(shingles, pa.binary()), places, spans], ["id", "h", "label", "shingles", "places", "covered"])
    run = substring._gaps(5, 50, 0.8, substring.PARAGRAPH, 20, False)[0]
    sizes = [out.num_rows for out in run([batch])]
    assert sum(sizes) > 65536 and max(sizes) < 65536 + 2 * 400, sizes


@pytest.mark.parametrize("few", [0, 2, 64])
def test_small_and_large_groups_of_gaps_give_the_same(spark, monkeypatch, few):
    """Copies with an edit in each, compared pair by pair or by all ways to part the words around the gap."""
    monkeypatch.setattr(substring, "FEW", few)
    r = random.Random(15)
    fresh = lambda n: " ".join(f"w{r.randrange(1 << 40)}" for _ in range(n))
    rows = []
    for g in range(0, 100, 10):  # the first document has 42 words, the others 44, a word of their own and 8 more
        line, tail = fresh(44), fresh(8)
        rows.append((g, f"{fresh(30)} {' '.join(line.split()[1:-1])} {fresh(20)}"))
        rows += [(g + k, f"{fresh(7 * k)} {line} {fresh(1)} {tail} {fresh(20)}") for k in range(1, 2 + g // 10 % 5)]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(x.id, x.first, x.last) for x in got} == {(i, 7 * (i % 10), 7 * (i % 10) + 52) for i, _ in rows if i % 10 > 1}
    assert all(x.component_id == x.id // 10 * 10 + 1 for x in got)


def test_equal_texts_are_cut_whole(spark):
    """All copies but the first one go, also where a near copy of that one is cut, and one text of two with an id."""
    r = random.Random(22)
    fresh = lambda n: " ".join(f"w{r.randrange(1 << 40)}" for _ in range(n))
    one, short, passage = fresh(70), fresh(49), fresh(60)
    rows = [(1, one), (2, one), (3, one + " " + fresh(5)), (4, short), (5, short), (6, passage), (7, passage + " " + one), (8, passage + " " + one), (8, one), (9, one)]
    for order in (rows, rows[::-1]):
        got = substring.repeated_passages(spark.createDataFrame(order, "doc_id long, text string").repartition(3)).collect()
        assert sorted((x.id, x.first, x.last) for x in got if x.id != 7) == [(2, 0, 69), (3, 0, 69), (8, 0, 69), (8, 0, 129), (9, 0, 69)]
        assert sorted(x.last - x.first + 1 for x in got if x.id == 7) == [60, 70]
        assert {x.component_id for x in got} == {1}


def test_rows_that_share_an_id(spark):
    r = random.Random(10)
    plain = lambda n: " ".join(word(r) for _ in range(n))
    passage, clean = plain(60), plain(200)
    rows = [(1, plain(40) + " " + passage), (2, plain(30)), (2, plain(90) + " " + passage), (2, clean), (2, clean), (3, passage + " " + plain(20)), (3, passage + " " + plain(25))]
    for order in (rows, rows[::-1]):
        documents = spark.createDataFrame([(*x, 7, "s", [1]) for x in order], "doc_id long, text string, _span_id long, span_h string, spans array<int>").repartition(2)
        left = substring.remove_repeats(documents)
        assert left.columns == documents.columns and left.dtypes == documents.dtypes
        got = left.collect()
        assert all(tuple(x)[2:] == (7, "s", [1]) for x in got)
        assert sorted(x.text for x in got if passage in x.text) == sorted([rows[0][1]])
        assert collections.Counter((x.doc_id, len(spaced(x.text))) for x in got) == collections.Counter([(1, 100), (2, 30), (2, 90), (2, 200), (2, 200), (3, 20), (3, 25)])


def test_spans_of_a_chain_do_not_overlap():
    """Edits so dense in the middle that parts are at the bar and their union is not."""
    r = random.Random(4)
    for _ in range(60):
        a = [r.randrange(1 << 40) for _ in range(160)]
        b = list(a)
        for k in range(10, 150, r.randrange(9, 17)):
            b[k] = -k
        x, y = shingled(a, b)
        spans = substring.common_spans(x, y, 5, 50, 0.8)
        assert all(e < s for (_, e), (s, _) in zip(spans, spans[1:]))
        for s, e in spans:
            assert best_jaccard(x, y[s : e - 3]) >= 0.8


def best_jaccard(a: np.ndarray, part: np.ndarray) -> float:
    """The highest Jaccard similarity of the shingles with those of any span of the other document."""
    want, best = set(part.tolist()), 0.0
    places = np.flatnonzero(np.isin(a, part)).tolist()
    for k, s in enumerate(places):
        seen: set[int] = set()
        at, shared = s, 0
        for e in places[k:]:
            new = set(a[at : e + 1].tolist()) - seen
            seen, at, shared = seen | new, e + 1, shared + len(new & want)
            best = max(best, shared / (len(want) + len(seen) - shared))
    return best


def test_stages_give_callers_columns_back(spark):
    r = random.Random(12)
    own = ["KEPT", "n_words", "longest", "contaminated", "kept_id", "_span_id", "spans", "n_hit", "base_failed", "c0", "id", "h", "node"]
    kinds = ["string", "long", "string", "int", "array<int>", "double"]
    values = ["mine", 111, "mine", 5, [1, 2], 0.5]
    plain = lambda n: " ".join(word(r) for _ in range(n))
    passage = plain(60)
    rows = [(i, plain(120) + (" " + passage if i % 2 else ""), *[values[k % 6] for k in range(len(own))]) for i in range(12)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` {kinds[k % 6]}" for k, c in enumerate(own))).repartition(2)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality long, toxic long")
    items = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    for stage in (lambda d: quality.keep_good(d, labels), jaccard.keep_one_each, substring.remove_repeats, lambda d: decontaminate.remove_contaminated(d, items)):
        left = stage(documents)
        assert left.columns == documents.columns and left.dtypes == documents.dtypes
        got = left.collect()
        assert 6 <= len(got) <= 12 and all(tuple(x)[2:] == rows[0][2:] for x in got)
    assert 0 not in {x.doc_id for x in got}


# ------------------------------------------------------------------ 8 rollups
def test_rollup_batches(spark, tmp_path):
    rollup = rollups.Rollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    schema = "change string, source string, lang string, tokenizer string, n_tokens long, old_n_tokens long"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    first = make(("insert", "a", "en", "1", 10, None), ("insert", "a", "en", "1", 5, None), ("insert", None, "en", "1", 7, None), ("other", "a", "en", "1", 99, None))
    second = make(("delete", "a", "en", "1", 5, None), ("revise", "a", "en", "1", 12, 10), ("delete", None, "en", "1", 7, None))
    assert rollup.commit("b1", first) and rollup.commit("b2", second)
    assert not rollup.commit("b2", second) and not rollup.commit("b1", first)
    (tmp_path / "r" / "00000002-b3").mkdir()  # a batch that failed half-way
    assert rollup.commit("b3", make(("insert", "a", "fr", "1", None, None)))
    assert {tuple(r) for r in rollup.totals().collect()} == {("a", "en", "1", 1, 12), ("a", "fr", "1", 1, 0)}


# ------------------------------------------------------------------ 9 chat formatting
def test_snapshots_collapse(spark):
    talk = [("user", "a"), ("assistant", "b"), ("user", None), ("assistant", "")]
    rows = [(1, k, *t, "x") for k, t in enumerate(talk)]
    rows += [(2, k, *t, "x") for k, t in enumerate(talk[:2])] + [(3, k + 5, *t, "x") for k, t in enumerate(talk)]
    rows += [(4, 0, "user", "a", "x"), (5, 0, "user", "other", "x"), (5, 0, "user", "b", "x"), (6, None, None, "a", "x"), (None, 0, "user", "z", "x")]
    got = {r.conv_id: (r.n_turns, r.n_logged, r.rendered) for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")).collect()}
    assert got == {
        1: (4, 2, "<|user|>\na\n<|assistant|>\nb\n<|user|>\n\n<|assistant|>\n\n"),
        5: (2, 1, "<|user|>\nb\n<|user|>\nother\n"),
        6: (1, 1, "<||>\na\n"),
    }
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ------------------------------------------------------------------ 10 benchmark decontamination
def item_words(s: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s or ""))


@pytest.mark.parametrize("bound", [1 << 20, 200])
def test_contamination(spark, docs, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", bound)  # the smaller one makes many blocks of the benchmark
    r = random.Random(6)
    long = [t for _, t in corpus() if t and len(spaced(t)) > 60]
    items = [(k, " ".join(spaced(r.choice(long))[5 : 5 + n])) for k, n in enumerate([13, 14, 30, 50, 12, 3, 40])]
    items += [(10, None), (11, ""), (12, "one"), (12, "one"), (None, " ".join(spaced(long[0])[:20])), (13, prose(r, 20))]
    got = collections.Counter()
    for x in decontaminate.find_contamination(docs, spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, n_hit int")).collect():
        got[(x.doc_id, x.text, x.n_words, x.n_hit, tuple(x.hit_items), x.contaminated)] += 1
        words = item_words(x.text)
        for m in x.matches:
            source = [item_words(t) for i, t in items if str(i) == str(m.item_id)]
            assert any(w[m.item_word : m.item_word + m.n] == words[m.word : m.word + m.n] for w in source)
    want = collections.Counter()
    for i, t in corpus():
        w, hit, found = item_words(t), set(), set()
        for k, item in items:
            x = item_words(item)
            n = min(13, len(x))
            windows = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if x else set()
            at = [j for j in range(len(w) - n + 1) if tuple(w[j : j + n]) in windows]
            hit.update(j + d for j in at for d in range(n))
            if at and k is not None:
                found.add(str(k))
        want[(i, t, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w))] += 1
    assert got == want


def test_no_benchmark_and_no_documents(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, none).where("contaminated").count() == 0
    assert decontaminate.remove_contaminated(spark.createDataFrame([], EMPTY), none).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_url_models_are_never_sent_whole(spark):
    """No table that grows with the urls is broadcast through the driver, however small it is here."""
    from attestry.llm import urls

    pages = [(k, f"https://{'www.' if k % 3 else ''}{'example.com' if k % 2 else 'site.net'}/{('en', 'es', 'fr')[k % 3]}/{k % 17}") for k in range(60)] + [(k, f"http://other{k % 9}.org/a/{k}") for k in range(60, 90)]
    judged = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"))
    ruled = spark.createDataFrame([("\u0002a.com/\u0003", True, 2), ("\u0002b.net/es/\u0003", False, 1)], "chars string, accepted boolean, weight long")
    scored = urls.score(ruled.select("chars"), urls.train(ruled))
    for df in (judged, scored):
        assert df.count() in (90, 2)
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
