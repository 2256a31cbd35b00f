"""Token ids in flat files that are memory-mapped: unsigned integers, with 64-bit offsets of the documents.

Rows are exchanged once, into ranges of ascending id; each range is a part, whose task encodes its texts and writes
three files:

    part-00007.ids      the ids of its documents one after another, little-endian unsigned, 2 bytes each where the
                        vocabulary allows it, else 4; every document ends with the end id
    part-00007.offsets  unsigned 64-bit: where each document starts in the part's ids, and at last their number
    part-00007.keys     the documents' own ids, an Arrow file of one column

and gives one row of counts. The prefix sums of these rows are the parts' bases: a document starts at its part's base
plus its offset. The table `manifest` beside the parts holds (part, width, n_docs, n_ids, first_doc, first_id). A task
writes under a name of its attempt and renames at the end, so that a part is whole or absent, and a task that
runs again writes the same bytes.

Texts are encoded word by word: ASCII white space parts tokens, merges and normalisation of the vocabulary, so the ids of
a text are those of its words one after another. A worker keeps a bounded table of the library's answers, from which words seen
once go first; new words of plain characters are parted into the vocabulary's pieces, whose merges the library makes. `splits_at_blanks` tells from a vocabulary's settings whether this holds; where it does not, texts are encoded whole.

Defined results: a null text is an empty one and has the end id only; documents are in ascending order of id, nulls first,
those of one id by their text's hash; equal rows are documents of their own; invalid UTF-8 is read as U+FFFD; an empty
table gives no files but an empty manifest, and no rows; other columns are not carried.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pfs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from pairline.llm.common import shared_dir, small_batches

#: The vocabulary of the registered query and the id that ends its documents.
VOCABULARY, END_ID = "word_bpe_49k.json", 1
#: Text bytes in a part; words encoded at once; words (and pieces of words) and ids that a worker remembers; ids that a reader holds at once.
PART_BYTES, CHUNK_WORDS, KEEP_WORDS, KEEP_IDS, READ_IDS = 128 << 20, 1 << 17, 1 << 18, 1 << 24, 1 << 21
# Fixed value: the pattern of pieces in which no blank can stand, as the vocabulary states it.
BLANK_FREE = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)
# Characters that normalisation leaves alone but for their case, and their pieces in lower case by that pattern.
LETTERS = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
PLAIN = re.compile(rf"[!-~{LETTERS}{LETTERS[1:-1].upper()}]+")
PLAIN_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LETTERS}]+|[0-9]|[^a-z0-9{LETTERS}]+")
MANIFEST = "part int, width int, n_docs long, n_ids long"


class _Places(dict):
    """Words by their place in the encoder's table; a word that is asked for first gets the next one."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


class Encoder:
    """Ids of texts by a vocabulary file of the tokenizers library."""

    def __init__(self, vocabulary: str = VOCABULARY, end_id: int = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
        self.end_id = end_id
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4")
        self.by_words = self.splits_at_blanks()
        self.as_bytes = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in LETTERS} if self.by_words else {}
        self.forget()

    def splits_at_blanks(self) -> bool:
        """Whether the vocabulary's own settings show that no token, merge or normalisation reaches over ASCII white space."""
        kept = json.loads(self.tokenizer.to_str())
        steps = [kept[k].get(plural, [kept[k]]) if kept[k] else [] for k, plural in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        plain = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and (x["pattern"], x["content"]) == ({"Regex": r"\s+"}, " ") for x in steps[0])
        first, *rest = steps[1] or [{}]
        parted = first.get("type") == "Split" and first["pattern"].get("Regex") in BLANK_FREE and first["invert"] and first["behavior"] == "Removed"
        bytewise = all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in rest)
        return plain and parted and bytewise and not any(len(x["content"].encode().split()) != 1 for x in kept["added_tokens"])

    def forget(self) -> None:
        self.places = _Places({None: 0})
        self.pieces: dict[str, bytes] = {}
        self.flat, self.starts, self.lengths = np.array([self.end_id], self.dtype), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.seen = np.ones(1, np.int64)

    def _keep_frequent(self) -> None:
        """Forget the words that were seen once, and all of them if that leaves more than half."""
        often = np.flatnonzero(self.seen > 1)
        often = np.append(0, often[often > 0])
        if 2 * len(often) > KEEP_WORDS or 2 * int(self.lengths[often].sum()) > KEEP_IDS:
            return self.forget()
        words = list(self.places)
        self.flat, self.lengths = self._gather(often), self.lengths[often]
        self.starts, self.seen = np.cumsum(self.lengths) - self.lengths, np.ones(len(often), np.int64)
        self.places = _Places((words[k], i) for i, k in enumerate(often.tolist()))

    def _gather(self, places: np.ndarray) -> np.ndarray:
        """The ids of the words at these places, one after another."""
        lengths = self.lengths[places]
        ends = np.cumsum(lengths)
        return self.flat[np.arange(ends[-1]) + np.repeat(self.starts[places] - ends + lengths, lengths)]

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts as the bytes of a file; thousands of lists would keep the garbage collector busy."""
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch([t.decode(errors="replace") for t in texts], add_special_tokens=False)]

    def _plain_ids(self, word: str) -> bytes:
        """The ids of a word of plain characters: those of its pieces, for each of which the vocabulary's merges are asked once."""
        out = b""
        for piece in PLAIN_PIECES.findall(word.lower()):
            ids = self.pieces.get(piece)
            if ids is None:
                tokens = self.tokenizer.model.tokenize(piece.translate(self.as_bytes))
                ids = self.pieces[piece] = array(self.dtype.char, [t.id for t in tokens]).tobytes()
            out += ids
        return out

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode(errors="replace") for w in words]
        plain = [PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts]
        others = iter(self._ids([w for w, p in zip(words, plain, strict=True) if not p]))
        found = [self._plain_ids(t) if p else next(others) for t, p in zip(texts, plain, strict=True)]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(lengths) - lengths)
        self.lengths, self.seen = np.append(self.lengths, lengths), np.append(self.seen, np.zeros(len(words), np.int64))
        self.flat = np.append(self.flat, np.frombuffer(b"".join(found), self.dtype))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with its end id, and how many each has."""
        if not self.by_words:
            end = np.array([self.end_id], self.dtype).tobytes()
            found = [ids + end for ids in self._ids(texts)]
            return np.frombuffer(b"".join(found), self.dtype), np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        if len(self.places) > KEEP_WORDS or len(self.flat) > KEEP_IDS:
            self._keep_frequent()
        if len(self.pieces) > KEEP_WORDS:
            self.pieces = {}
        # Arrow parts at the six ASCII blanks only, and leaves an empty word where a text begins or ends with one
        parted = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        words = parted.flatten().dictionary_encode()
        distinct = words.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False)
        known = len(self.places)
        numbers = np.fromiter(map(self.places.__getitem__, distinct), np.int64, len(distinct))
        if len(self.places) > known:
            self._learn(list(islice(self.places, known, None)))
        edges = parted.offsets.to_numpy() - parted.offsets[0].as_py()
        places = np.zeros(len(words) + len(texts), np.int64)  # each text's words, then the end id
        inner = np.ones(len(places), bool)
        inner[edges[1:] + np.arange(len(texts))] = False
        places[inner] = numbers[words.indices.to_numpy()]
        self.seen += np.bincount(places, minlength=len(self.seen))
        return self._gather(places), np.add.reduceat(self.lengths[places], edges[:-1] + np.arange(len(texts)))


@lru_cache(maxsize=2)
def encoder_of(vocabulary: str, end_id: int) -> Encoder:
    """One for a worker process, which runs many tasks."""
    return Encoder(vocabulary, end_id)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts) of a batch, about CHUNK_WORDS words at a time; a longer text is a chunk of its own."""
    texts, first, held = [], 0, 0
    for i, text in enumerate(batch.column("text").to_pylist()):
        texts.append(text)
        held += len(text)
        if held > 6 * CHUNK_WORDS:
            yield first, texts
            texts, first, held = [], i + 1, 0
    if texts:
        yield first, texts


def _place(folder: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(folder) if ":" in folder else (pfs.LocalFileSystem(), folder)


def write_token_files(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, part_bytes: int = PART_BYTES) -> str:
    """Write the ids of all documents to a new folder, which executors share; gives the folder."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("key"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(-(-size // part_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the place in the scan parts equal rows, so that an id or a row that is very frequent still lies in many ranges
    tagged = rows.withColumns({"__hash": F.xxhash64("text"), "__place": F.monotonically_increasing_id()})
    order = ["key", "__hash", "__place"]
    ranged = tagged.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, root = _place(folder)
        store.create_dir(root, recursive=True)
        names = {kind: (f"{root}/.{attempt}-{part}.{kind}", f"{root}/part-{part:05d}.{kind}") for kind in ("ids", "offsets", "keys")}
        encoder, n_docs, n_ids = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if encoder is None:
                encoder = encoder_of(vocabulary, end_id)
                out = {kind: store.open_output_stream(name) for kind, (name, _) in names.items()}
                keys = pa.ipc.new_file(out["keys"], pa.schema([batch.schema.field("key")]))
            for first, texts in _chunks(batch):
                ids, lengths = encoder.encode(texts)
                out["ids"].write(ids.tobytes())
                out["offsets"].write((n_ids + np.cumsum(lengths) - lengths).astype("<u8").tobytes())
                keys.write_batch(pa.RecordBatch.from_arrays([batch.column("key").slice(first, len(texts))], ["key"]))
                n_docs, n_ids = n_docs + len(texts), n_ids + len(ids)
        if encoder is not None:
            out["offsets"].write(np.array([n_ids], "<u8").tobytes())
            keys.close()
            for kind, (name, final) in names.items():
                out[kind].close()
                store.move(name, final)
            row = [part, encoder.dtype.itemsize, n_docs, n_ids]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["part", "width", "n_docs", "n_ids"])

    counts = ranged.mapInArrow(run, MANIFEST)
    counts.write.parquet(f"{folder}/counts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    bases = {name: F.coalesce(F.sum(of).over(before), F.lit(0)) for name, of in (("first_doc", "n_docs"), ("first_id", "n_ids"))}
    spark.read.schema(MANIFEST).parquet(f"{folder}/counts").withColumns(bases).write.parquet(f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{MANIFEST}, first_doc long, first_id long").parquet(f"{folder}/manifest")


class Part:
    """The documents of one part; files on a mounted file system are mapped, others are read in the ranges asked for."""

    def __init__(self, folder: str, part: int, width: int):
        self.store, self.root = _place(folder)
        self.name, self.dtype = f"{self.root}/part-{part:05d}", np.dtype(f"<u{width}")
        self.ids = self._open("ids")
        self.offsets = np.frombuffer(self._open("offsets").read_buffer(), "<u8").astype(np.int64)

    def _open(self, kind: str):
        path = f"{self.name}.{kind}"
        return pa.memory_map(path) if isinstance(self.store, pfs.LocalFileSystem) else self.store.open_input_file(path)

    def keys(self) -> pa.ChunkedArray:
        return pa.ipc.open_file(self._open("keys")).read_all().column(0)

    def read(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end of the part."""
        self.ids.seek(start * self.dtype.itemsize)
        return np.frombuffer(self.ids.read_buffer((end - start) * self.dtype.itemsize), self.dtype)


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, read from the files; with its ids if asked for.

    start counts the ids of all documents before; the checksum is taken over ids of four bytes.
    """
    parts, more = manifest(spark, folder), ", ids array<long>" * with_ids
    first = parts.orderBy("part").first()
    if first is None:
        return spark.createDataFrame([], f"`{id_col}` long, start long, n_tokens long, ids_crc32 long{more}")
    key_type = from_arrow_type(Part(folder, first["part"], first["width"]).keys().type).simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from read_part(row)

    def read_part(row: dict) -> Iterator[pa.RecordBatch]:
        part = Part(folder, row["part"], row["width"])
        keys, at = part.keys(), part.offsets
        low = 0
        while low < row["n_docs"]:
            high = max(low + 1, int(np.searchsorted(at, at[low] + READ_IDS, "right")) - 1)
            ids = part.read(int(at[low]), int(at[high]))
            edges = (at[low : high + 1] - at[low]).tolist()
            wide = ids.astype("<u4")
            crcs = [zlib.crc32(wide[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
            columns = [keys.slice(low, high - low).combine_chunks(), pa.array(at[low:high] + row["first_id"]), pa.array(np.diff(at[low : high + 1])), pa.array(crcs, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, [id_col, "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
            low = high

    schema = f"`{id_col}` {key_type}, start long, n_tokens long, ids_crc32 long{more}"
    return parts.repartition(parts.count()).mapInArrow(run, schema)


class TokenReader:
    """Training reads by place: any stretch of the ids of all parts, and any document."""

    def __init__(self, rows: list, folder: str):
        """rows: the manifest's."""
        rows = sorted(rows, key=lambda r: r["part"])
        self.parts = [Part(folder, r["part"], r["width"]) for r in rows]
        self.docs, self.ids = ([0, *accumulate(r[c] for r in rows)] for c in ("n_docs", "n_ids"))

    def __len__(self) -> int:
        return self.docs[-1]

    def __getitem__(self, i: int) -> np.ndarray:
        """The ids of the i-th document."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = int(np.searchsorted(self.docs, i, "right")) - 1
        a, b = self.parts[k].offsets[i - self.docs[k] : i - self.docs[k] + 2].tolist()
        return self.parts[k].read(a, b)

    def stretch(self, start: int, n: int) -> np.ndarray:
        """n ids from the start-th id on, fewer at the end."""
        found, end = [np.zeros(0, np.int64)], min(start + n, self.ids[-1])
        k = int(np.searchsorted(self.ids, start, "right")) - 1
        while start < end:
            high = min(end, self.ids[k + 1])
            found.append(self.parts[k].read(start - self.ids[k], high - self.ids[k]))
            start, k = high, k + 1
        return np.concatenate(found)
