"""Hybrid search of a query table in which every query asks one knowledge base.

The chunks are stored once more by knowledge base ("shelves"): terms, lower-cased text and slot sums of the hash
vector. A task takes a run of queries of one knowledge base and reads that shelf piece after piece, so candidates
are never shuffled: only the final hits of a query leave the task, whatever the number of chunks that were looked at.
Full text and containment compare whole runs with a piece at a time; memory is bounded by a run and a piece.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from attestry.functions import text as tx
from attestry.functions.session import opened
from attestry.lexicons import DEFAULT_DICTIONARY, TermDictionary
from attestry.operators import normalize as nz
from attestry.operators import vectors as vc

SHELVES = 64  # folders that the knowledge bases are dealt to
RUN_ROWS = 16_384  # queries of one knowledge base that a task answers at a time
PIECE_ROWS = 4_096  # chunks that are compared with a run at a time
HELD_ROWS = 400_000  # hits that a run holds before it cuts them to the first ones of each text
CANDIDATES = 1 << 20  # pairs of a text and a chunk that are checked at a time
WIDEST = 64  # characters of a needle that are looked for by their hash
_BASE, _MIX, _BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 22
_OLDEST = np.iinfo(np.int64).min


def shelf_of(knowledge_base):
    return F.pmod(F.xxhash64(knowledge_base), F.lit(SHELVES)).cast("int")


def write_shelves(chunks: DataFrame, folder: str, dictionary: TermDictionary = DEFAULT_DICTIONARY) -> str:
    """The chunks as rows to search, by shelf; every task writes its own in order, without a shuffle."""
    stripped = tx.strip(F.col("content"))
    rows = chunks.where(F.col("knowledge_base_id").isNotNull()).select(
        shelf_of("knowledge_base_id").alias("shelf"), "knowledge_base_id", "chunk_id", "doc_uid", "chunk_index",
        F.unix_micros(F.col("updated_at").cast("timestamp")).alias("newest"),
        tx.words_of(nz.index_text(F.col("content"), dictionary)).alias("terms"),
        F.lower("content").alias("hay"), F.length(stripped).alias("length"), vc.hash_sums(F.col("content")).alias("sums"),
    )
    rows = rows.sortWithinPartitions("shelf", "knowledge_base_id", "doc_uid", "chunk_index")
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("shelf").parquet(folder)
    return folder


def _pieces(folder: str, shelf: int, base: str, columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The chunks of a knowledge base in pieces; each is in order of document and chunk."""
    system, files = opened(f"{folder}/shelf={shelf}")
    for f in files:
        with system.open_input_file(f) as source:
            for batch in pq.ParquetFile(source).iter_batches(PIECE_ROWS, columns=["knowledge_base_id", *columns]):
                own = batch.filter(pc.equal(batch["knowledge_base_id"], base))
                if len(own):
                    yield own


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, … of every range, one after the other."""
    end = np.cumsum(count)
    return np.repeat(begin - (end - count), count) + np.arange(end[-1] if len(end) else 0)


def _places(of: np.ndarray) -> np.ndarray:
    """The place of each row among the rows before it with the same, adjacent, value."""
    new = np.ones(len(of), bool)
    new[1:] = of[1:] != of[:-1]
    first = np.flatnonzero(new)
    return np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))


def _spans(start: np.ndarray, end: int) -> Iterator[tuple[int, int]]:
    return zip(start.tolist(), [*start[1:].tolist(), end])


class _Firsts:
    """The first rows of every text by some order, cut now and then."""

    def __init__(self, order: list[str], down: list[str], limit: np.ndarray) -> None:
        self.order, self.ascending, self.limit = order, [c not in down for c in order], limit
        self.parts: list[pd.DataFrame] = []
        self.held = 0

    def add(self, of: np.ndarray, piece: pa.RecordBatch, item: np.ndarray) -> None:
        taken = {c: piece[c].take(pa.array(item)).to_numpy(zero_copy_only=False) for c in ("chunk_id", "doc_uid", "chunk_index")}
        if "newest" in self.order:
            taken["newest"] = piece["newest"].fill_null(_OLDEST).to_numpy()[item]
        self.parts.append(pd.DataFrame({"of": of, **taken}))
        self.held += len(of)
        if self.held > HELD_ROWS:
            self.held = len(self.cut())

    def cut(self) -> pd.DataFrame:
        rows = pd.concat(self.parts) if self.parts else pd.DataFrame({c: [] for c in ("of", "chunk_id", "doc_uid", "chunk_index", "newest")})
        rows = rows.sort_values(["of", *self.order], ascending=[True, *self.ascending], kind="stable")
        of = rows["of"].to_numpy(dtype=int)
        place = _places(of)
        kept = place < self.limit[of]
        rows = rows[kept]
        self.parts = [rows]
        return rows.assign(pos=place[kept] + 1)


# ------------------------------------------------------------------------- full text
def _holding_all(codes: np.ndarray, lengths: np.ndarray, limit: np.ndarray, words: pa.Array, terms: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, chunk) pairs of a piece in which the chunk has all words, the first ones of each text.

    Texts come as their words' places in ``words``. One with a word that no chunk of the piece has is out at once; the
    others begin with the chunks of their rarest word and are checked word after word.
    """
    code = pc.index_in(terms.flatten(), value_set=words)
    known = code.is_valid().to_numpy(zero_copy_only=False)
    item = pc.list_parent_indices(terms).to_numpy()[known].astype(np.int64)
    code = code.drop_null().to_numpy().astype(np.int64)
    order = np.argsort(code, kind="stable")
    code, item = code[order], item[order]
    key = code * len(terms) + item
    found = np.bincount(code, minlength=len(words))
    begin = np.cumsum(found) - found
    start = np.cumsum(lengths) - lengths
    if not len(key) or not len(lengths):
        return
    least = np.minimum.reduceat(found[codes], start)
    alive = np.flatnonzero(least > 0)
    group = np.cumsum(least[alive]) // CANDIDATES
    for low, high in _spans(np.flatnonzero(_places(group) == 0), len(alive)):
        some = alive[low:high]
        size = lengths[some]
        own = codes[_ranges(start[some], size)]
        own = own[np.lexsort((found[own], np.repeat(np.arange(len(some)), size)))]
        first = np.cumsum(size) - size
        driver = own[first]
        text, chunk = np.repeat(np.arange(len(some)), found[driver]), item[_ranges(begin[driver], found[driver])]
        j = 1
        while len(open_ := np.flatnonzero(size[text] > j)):
            want = own[first[text[open_]] + j] * len(terms) + chunk[open_]
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            held = np.ones(len(text), bool)
            held[open_] = key[at] == want
            text, chunk, j = text[held], chunk[held], j + 1
        text = some[text]
        kept = _places(text) < limit[text]
        if kept.any():
            yield text[kept], chunk[kept]


# ----------------------------------------------------------------------- containment
def _points(texts: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _hashes(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of all windows of 1, 2, 4 … characters along the last axis."""
    hashed, width, power = (points + np.uint64(1)) * _MIX, 1, _BASE
    while hashed.shape[-1]:
        yield width, hashed
        if width == WIDEST or hashed.shape[-1] <= width:
            return
        hashed, width, power = hashed[..., :-width] * power + hashed[..., width:], width * 2, power * power


class _Needles:
    """Distinct texts to be found in other texts, by the hash of their first characters, a power of two of them."""

    def __init__(self, needles: list[str]) -> None:
        self.needles = needles
        length = np.array([len(n) for n in needles], dtype=np.int64)
        width = np.minimum(1 << np.floor(np.log2(np.maximum(length, 1))).astype(int), WIDEST)
        self.by_width = {}
        with np.errstate(over="ignore"):
            for w in np.unique(width[length > 0]).tolist():
                own = np.flatnonzero((width == w) & (length > 0))
                heads = _points([needles[k][:w] for k in own]).reshape(len(own), w)
                value = dict(_hashes(heads))[w][:, 0]
                order = np.argsort(value, kind="stable")
                seen = np.zeros(1 << _BITS, bool)
                seen[(value * _MIX) >> np.uint64(64 - _BITS)] = True
                self.by_width[w] = value[order], own[order], seen

    def found(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(needle, text) pairs, each once."""
        length = np.array([len(t) for t in texts], dtype=np.int64)
        end = np.cumsum(length)
        with np.errstate(over="ignore"):
            for w, hashed in _hashes(_points(texts)):
                if w not in self.by_width:
                    continue
                value, needle, seen = self.by_width[w]
                at = np.flatnonzero(seen[(hashed * _MIX) >> np.uint64(64 - _BITS)])
                text = np.searchsorted(end, at, "right")
                start = np.flatnonzero(_places(text) == 0)  # a text's places go together, so that a pair comes once
                for low, high in _spans(start[_places(start // CANDIDATES) == 0], len(at)):
                    place = hashed[at[low:high]]
                    left = np.searchsorted(value, place, "left")
                    many = np.searchsorted(value, place, "right") - left
                    pairs = needle[_ranges(left, many)] * len(texts) + np.repeat(text[low:high], many)
                    pairs = np.unique(pairs)
                    held = [self.needles[n] in texts[t] for n, t in zip((pairs // len(texts)).tolist(), (pairs % len(texts)).tolist())]
                    pairs = pairs[np.array(held, dtype=bool)] if len(pairs) else pairs
                    if len(pairs):
                        yield pairs // len(texts), pairs % len(texts)


# ------------------------------------------------------------------------- one run
def _fulltext(run: pa.Table, folder: str, shelf: int, base: str) -> pd.DataFrame:
    """(q, f_rank, chunk_id, doc_uid): the first ``fulltext_k`` chunks of every query, as ``fulltext_hits`` has them."""
    variants = run["variants"].combine_chunks()
    query = pc.list_parent_indices(variants).to_numpy()
    number = _places(query) + 1
    words, needles = variants.flatten().field("words"), variants.flatten().field("needle").to_pylist()
    limit = run["fulltext_k"].to_numpy()[query]
    lengths = pc.list_value_length(words).to_numpy()
    worded = np.flatnonzero(lengths > 0)
    encoded = words.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy().astype(np.int64)
    matches = _Firsts(["doc_uid", "chunk_index"], [], limit)
    if len(worded):
        for piece in _pieces(folder, shelf, base, ["chunk_id", "doc_uid", "chunk_index", "terms"]):
            for text, chunk in _holding_all(codes, lengths[worded], limit[worded], encoded.dictionary, piece["terms"]):
                matches.add(worded[text], piece, chunk)
    matched = matches.cut()
    unmatched = np.setdiff1d(np.arange(len(query)), matched["of"].to_numpy(dtype=int))
    unmatched = unmatched[[len(needles[v]) > 0 for v in unmatched.tolist()]] if len(unmatched) else unmatched
    asked = pd.DataFrame({"variant": unmatched, "needle": [needles[v] for v in unmatched.tolist()]})
    asked["of"], distinct = pd.factorize(asked["needle"])
    found = _Firsts(["newest", "doc_uid", "chunk_index"], ["newest"], np.full(len(distinct), limit.max(initial=0)))
    if len(distinct):
        sought = _Needles(list(distinct))
        for piece in _pieces(folder, shelf, base, ["chunk_id", "doc_uid", "chunk_index", "newest", "hay"]):
            for needle, chunk in sought.found(piece["hay"].fill_null("").to_pylist()):
                found.add(needle, piece, chunk)
    fallback = found.cut().merge(asked[["of", "variant"]], on="of")
    columns = ["variant", "pos", "chunk_id", "doc_uid"]
    rows = pd.concat([matched.rename(columns={"of": "variant"})[columns], fallback[columns]])
    variant = rows["variant"].to_numpy(dtype=int)
    rows = rows.assign(q=query[variant], number=number[variant])[rows["pos"].to_numpy() <= limit[variant]]
    rows = rows.sort_values(["q", "number", "pos"], kind="stable").drop_duplicates(["q", "chunk_id"])
    rows["f_rank"] = rows.groupby("q").cumcount() + 1
    return rows[rows["f_rank"].to_numpy() <= run["fulltext_k"].to_numpy()[rows["q"].to_numpy(dtype=int)]][["q", "f_rank", "chunk_id", "doc_uid"]]


def _nearest(run: pa.Table, folder: str, shelf: int, base: str) -> pd.DataFrame:
    """(q, v_rank, chunk_id, doc_uid, distance): the ``vector_k`` nearest chunks of every query that has a text."""
    limit = run["vector_k"].to_numpy()
    texts = run["stripped"].to_pylist()
    own = np.array([k for k, t in enumerate(texts) if t is not None], dtype=int)
    block = {"ids": own, "matrix": vc.bag_of_characters([texts[k] for k in own], vc.DIMENSION), "filters": {}}
    near = vc._Nearest(block, int(limit.max(initial=1)))
    if len(own):
        for piece in _pieces(folder, shelf, base, ["chunk_id", "doc_uid", "length", "sums"]):
            piece = piece.filter(pc.is_valid(piece["sums"]))
            points = vc.averaged(vc._points(piece["sums"]), piece["length"].to_numpy())
            if len(piece):
                near.add({"points": points, **{c: piece[c].to_numpy(zero_copy_only=False) for c in ("chunk_id", "doc_uid")}})
                near.cut()
    rows = near.cut()
    rows = rows.assign(q=own[rows["q"].to_numpy(dtype=int)], v_rank=rows.groupby("q").cumcount() + 1)
    return rows[rows["v_rank"].to_numpy() <= limit[rows["q"].to_numpy(dtype=int)]]


def _merged(run: pa.Table, fulltext: pd.DataFrame, nearest: pd.DataFrame) -> pd.DataFrame:
    """Both lists in hybrid order, as ``merged_hits`` has them."""
    both = fulltext.merge(nearest[["q", "v_rank", "chunk_id", "doc_uid", "distance"]], on=["q", "chunk_id"], how="outer", suffixes=("", "_v"))
    both["doc_uid"] = both["doc_uid"].where(both["doc_uid"].notna(), both["doc_uid_v"])
    both = both.sort_values(["q", "f_rank", "v_rank", "chunk_id"], kind="stable")
    score, text, vector = 1 - both["distance"], both["f_rank"].notna(), both["v_rank"].notna()
    both["score"] = np.where(text & vector, np.maximum(score, 0.0), score)
    both["retrieval_source"] = np.select([text & vector, text], ["hybrid", "fulltext"], "vector")
    both["rank"] = both.groupby("q").cumcount() + 1
    return both


def _answers(run: pa.Table, folder: str, cut: bool, keep: Sequence[str], arrow: pa.Schema) -> pa.Table:
    shelf, base = run["shelf"][0].as_py(), run["knowledge_base_id"][0].as_py()
    rows = _merged(run, _fulltext(run, folder, shelf, base), _nearest(run, folder, shelf, base))
    of = rows["q"].to_numpy(dtype=int)
    if cut:
        kept = rows["rank"].to_numpy() <= run["k"].to_numpy()[of]
        rows, of = rows[kept], of[kept]
    own = run.select(list(keep)).take(pa.array(of))
    score = rows["score"].to_numpy(dtype=float)
    made = {"rank": rows["rank"], "chunk_id": rows["chunk_id"], "doc_uid": rows["doc_uid"], "retrieval_source": rows["retrieval_source"]}
    columns = [*own.columns, *[pa.array(v.to_numpy(dtype=object), arrow.field(c).type) for c, v in made.items()], pa.array(score, pa.float64(), mask=np.isnan(score))]
    return pa.table(columns, names=[*keep, *made, "score"]).cast(arrow)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The queries that come in order of knowledge base as runs of one, of bounded length."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        base = np.array(batch["knowledge_base_id"].to_pylist(), dtype=object)
        edges = [0, *(np.flatnonzero(base[1:] != base[:-1]) + 1).tolist(), len(base)]
        for low, high in zip(edges, edges[1:]):
            if low == high:
                continue
            if held and (held[0]["knowledge_base_id"][0].as_py() != base[low] or sum(map(len, held)) + high - low > RUN_ROWS):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def prepared(queries: DataFrame, dictionary: TermDictionary = DEFAULT_DICTIONARY, keep: Sequence[str] = ("query_id",), variants: int = 6) -> DataFrame:
    """The queries as a task reads them, in ranges of knowledge base and query; texts are expanded behind the shuffle."""
    total = queries.count()
    cores = queries.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-total // RUN_ROWS), min(2 * cores, -(-total // 256)))
    kept = list(dict.fromkeys([*keep, "knowledge_base_id", "text", "k", "fulltext_k", "vector_k"]))
    dealt = queries.select("query_id", *[c for c in kept if c != "query_id"]).repartitionByRange(parts, "knowledge_base_id", "query_id")
    dealt = dealt.sortWithinPartitions("knowledge_base_id", "query_id")
    text = F.col("text")
    each = F.transform(nz.expansions(text, dictionary, variants), lambda v: F.struct(tx.words_of(v).alias("words"), F.lower(v).alias("needle")))
    return dealt.select(*[c for c in kept if c != "text" or c in keep], shelf_of("knowledge_base_id").alias("shelf"), tx.strip(text).alias("stripped"), each.alias("variants"))


def search_shelves(queries: DataFrame, folder: str, dictionary: TermDictionary = DEFAULT_DICTIONARY, cut: bool = True, keep: Sequence[str] = ("query_id",)) -> DataFrame:
    """Hybrid hits of queries (query_id, knowledge_base_id, text, k, fulltext_k, vector_k) that all name a knowledge base.

    The rows are those of full-text search, vector search and ``merged_hits`` over the same chunks, with ``keep`` columns
    of the query; with ``cut`` the first k of each. ``queries`` is read more than once and should be stored.
    """
    made = [("rank", T.IntegerType()), ("chunk_id", T.StringType()), ("doc_uid", T.StringType()), ("retrieval_source", T.StringType()), ("score", T.DoubleType())]
    schema = T.StructType([*[T.StructField(c, queries.schema[c].dataType) for c in keep], *[T.StructField(n, t) for n, t in made]])
    arrow, names, step = to_arrow_schema(schema), list(keep), vc.STEP_ROWS

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            yield from _answers(run, folder, cut, names, arrow).to_batches(step)

    source = F.col("retrieval_source")
    sources = F.when(source == "hybrid", F.array(F.lit("fulltext"), F.lit("vector"))).otherwise(F.array(source))
    found = prepared(queries, dictionary, keep).mapInArrow(answer, schema)
    return found.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("matched_sources", sources)
