"""Token ids as flat binary files.

Documents are ordered by id over the partitions of a range partitioning. Every partition is one pair of files:
``.bin`` has its ids one after the other (unsigned, little-endian, 16 bits where the vocabulary allows, else
32), ``.idx`` has the 64-bit offsets of its documents, one more than there are, and their ids. A partition's
base, the ids of all partitions before it, is a prefix sum over one row a partition. Readers map the files
into memory and take slices. A file is written under another name and moved when it is whole, and its content
follows from its partition, so attempts that are repeated after a lost executor change nothing.
"""

from __future__ import annotations

import itertools
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import store, texts

END = 0
KNOWN = 800_000  # pretokens whose ids a worker remembers,
KEEP_CHARS = 32  # of at most so many characters, which bounds their bytes
NO_ID = -(1 << 63)
_PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed by byte-level BPE


def public_vocabulary() -> str:
    """Path of the default vocabulary, a byte-level BPE of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, int]:
    """The characters by which byte-level BPE names bytes: printable ones stand for themselves, the others for 256 and on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: 256 + k for k, b in enumerate(others)}


class _Known(dict):
    """Ids of pretokens, encoded by the vocabulary's model when they are first asked for; long ones are not kept."""

    def __init__(self, model, kind: str) -> None:
        super().__init__()
        self.tokenize, self.letters, self.code = model.model.tokenize, _byte_letters(), "H" if kind == "<u2" else "I"

    def __missing__(self, piece: str) -> bytes:
        named = piece.encode().decode("latin-1").translate(self.letters)
        ids = array(self.code, [t.id for t in self.tokenize(named)])
        if sys.byteorder == "big":
            ids.byteswap()
        made = ids.tobytes()
        if len(piece) <= KEEP_CHARS and len(self) < KNOWN:
            self[piece] = made
        return made


class Encoder:
    """Ids of whole texts, equal to encoding them in one go.

    Byte-level BPE works on each pretoken by itself, so a text is cut by the pretoken pattern and what a
    pretoken encodes to is remembered. Texts with a special token's string are encoded as they are.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.kind = "<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4"
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.pretokens = regex.compile(_PRETOKENS)
        self.known = _Known(self.model, self.kind)

    def __call__(self, batch: list[str]) -> list[bytes]:
        end, get, cut = np.asarray([END], self.kind).tobytes(), self.known.__getitem__, self.pretokens.findall
        # A text with a special token's string is looked up as one piece and not kept.
        whole = lambda text: np.asarray(self.model.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return [(whole(text) if any(s in text for s in self.special) else b"".join(map(get, cut(text)))) + end for text in batch]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_token_files(documents: DataFrame, folder: str, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, an end id after each, and write the files in ascending order of ids.

    Returns the manifest: ``part``, ``docs``, ``ids`` and ``base`` (ids before the partition). A null text is
    empty and so only the end id. Rows without id come first; repeated rows are written as often as they are.
    """
    spark = documents.sparkSession
    texts.small_batches(spark)
    path = vocabulary or public_vocabulary()
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # Rows of one id, or of none, may be many: ranges go on inside them by the beginnings of their texts.
    docs = docs.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "id", F.substring("text", 1, 64)).sortWithinPartitions("id", "text")

    def run(batches):
        encode = encoder(path)
        part = TaskContext.get().partitionId()
        system, place = _place(folder)
        system.create_dir(place, recursive=True)
        names = [f"{place}/{part:06d}.{kind}" for kind in ("bin", "idx")]
        drafts = [f"{n}.{uuid.uuid4().hex}" for n in names]
        width = np.dtype(encode.kind).itemsize
        offsets, ids = [0], []
        with system.open_output_stream(drafts[0]) as out:
            for batch in batches:
                for low, high, _, _ in texts.blocks(batch["text"]):
                    for made in encode(batch["text"].slice(low, high - low).to_pylist()):
                        out.write(made)
                        offsets.append(offsets[-1] + len(made) // width)
                ids.append(batch["id"].fill_null(NO_ID).to_numpy(zero_copy_only=False))
        with system.open_output_stream(drafts[1]) as out:
            out.write(np.asarray(offsets, "<i8").tobytes())
            for column in ids:
                out.write(column.astype("<i8").tobytes())
        for draft, name in zip(drafts, names):
            system.move(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (part, len(offsets) - 1, offsets[-1], width)], ["part", "docs", "ids", "width"])

    made = store.stored(docs.mapInArrow(run, "part long, docs long, ids long, width long"), "manifest")
    rows = made.orderBy("part").collect()  # one row a partition
    bases = [0, *itertools.accumulate(r.ids for r in rows)]
    return spark.createDataFrame([(r.part, r.docs, r.ids, r.width, b) for r, b in zip(rows, bases)], "part long, docs long, ids long, width long, base long")


def read_token_files(manifest: DataFrame, folder: str, columns: str, each: Callable[[np.ndarray], tuple]) -> DataFrame:
    """Per document ``id``, ``start`` (ids of all documents before it), ``n_tokens`` and what ``each`` makes of its ids."""
    spark = manifest.sparkSession
    names = [c.split()[0] for c in columns.split(",")]

    def run(batches):
        system, place = _place(folder)
        local = isinstance(system, fs.LocalFileSystem)

        def mapped(name: str) -> np.ndarray:
            if local:
                return np.memmap(name, np.uint8, "r") if system.get_file_info(name).size else np.zeros(0, np.uint8)
            return np.frombuffer(system.open_input_file(name).read(), np.uint8)

        for batch in batches:
            for row in batch.to_pylist():
                n = row["docs"]
                index = mapped(f"{place}/{row['part']:06d}.idx").view("<i8")
                ids = mapped(f"{place}/{row['part']:06d}.bin").view(f"<u{row['width']}")
                offsets, docs = index[: n + 1], index[n + 1 :]
                for low in range(0, n, 4096):
                    at = np.asarray(offsets[low : low + 4097])
                    made = [each(ids[a:z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
                    own = np.asarray(docs[low : low + 4096])
                    arrays = [pa.array(own, mask=own == NO_ID), pa.array(at[:-1] + row["base"]), pa.array(np.diff(at))]
                    arrays += [pa.array([m[k] for m in made], pa.int64()) for k in range(len(names))]
                    yield pa.RecordBatch.from_arrays(arrays, ["id", "start", "n_tokens", *names])

    spread = max(1, min(manifest.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return manifest.repartition(spread, "part").mapInArrow(run, f"id long, start long, n_tokens long, {columns}")


def checksum(ids: np.ndarray) -> tuple[int]:
    return (zlib.crc32(ids.astype("<u4").tobytes()),)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = store.shared(spark, "tokens")
    manifest = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_token_files(manifest, folder, "ids_crc32 long", checksum).withColumnRenamed("id", "doc_id")
