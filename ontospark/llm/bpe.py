"""BPE encoding and decoding through a table of distinct words.

A BPE vocabulary with word ends merges inside pre-tokens ("words") only, so a
text's ids are its words' ids in order. Each task counts its distinct words;
the counts are summed by word, and every distinct word of the corpus is encoded
once. The ``FREQUENT`` commonest words are known to every task by number. A
second pass writes each text as its words' numbers, in blocks of a few MB of
text; words that aren't frequent get a number within their block and travel as
rows ``(block, number, word)``, are joined to the word table, and their ids go
back to the block by number. Such a word is rare by construction, so no key of
that join is hot, and the number of rows is in proportion to the input.

Decoding joins ids to the pieces of the vocabulary: the id-to-piece table has a
fixed number of rows, so each task holds it whole and joins by position.

Null and empty texts have no ids and decode to the empty string. Rows are
kept as they are, repeated ones too; a null id is an id like any other. Ids
are packed as little-endian unsigned 32-bit integers in one binary value.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ontospark.llm.words import chunks, lean
from ontospark.runtime import batches_bounded, drop_materialized, materialize, path_exists, remove_path, scratch_path

#: UTF-8 bytes of text per block, about; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Words that every task knows by number, at most, and the longest such word in characters: together they bound what is broadcast.
FREQUENT, FREQUENT_CHARS = 3 << 16, 64
#: Distinct words that a task counts before it hands them on.
COUNTED = 1 << 20
#: Words per batch that a task hands on or gathers.
ROWS = 1 << 16


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@functools.lru_cache(4)
def _word_tokenizer(path: str):
    """The tokenizer for words that are normalised already: normalising twice can differ from once."""
    from tokenizers import normalizers

    out = _load(path)
    out.normalizer = normalizers.Sequence([])
    return out


class Splitter:
    """Splits a text into the tokenizer's pre-tokens, as normalised strings.

    The tokenizer's own normaliser and pre-tokenizer do the work. Texts of the
    common Latin letters alone go through one equivalent pattern instead, if
    the vocabulary is of the kind that it stands for.
    """

    #: The pattern of the word-end vocabulary's own file.
    KNOWN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    def __init__(self, path: str):
        import json

        self.tok = _load(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = regex.compile("(" + "|".join(sorted((regex.escape(x["content"]) for x in spec["added_tokens"]), key=len, reverse=True)) + ")") if spec["added_tokens"] else None
        if any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
            raise ValueError("added tokens that depend on their surroundings aren't supported")
        first = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.known = first.get("pattern", {}).get("Regex") == self.KNOWN and first.get("invert") is True and kinds == ["NFC", "Replace", "Lowercase"]
        latin = [chr(c) for c in [*range(32, 127), *range(0xA0, 0x250)]]
        # Letters whose lower case is no single letter of the same range take the long way.
        plain = "".join(re.escape(c) for c in latin if c.lower() in latin)
        self.odd = re.compile(f"[^\t\n\r{plain}]|<\\|").search
        letters = "".join(c for c in latin if unicodedata.category(c)[0] == "L")
        numbers = "".join(c for c in latin if unicodedata.category(c)[0] == "N")
        self.words = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+").findall

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.known and not self.odd(text):
            return self.words(text.lower())
        out = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(part)
            elif part:
                part = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
                out.extend(part[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(part))
        return out


@functools.lru_cache(4)
def _splitter(path: str) -> Splitter:
    return Splitter(path)


@functools.lru_cache(4)
def _pieces(path: str) -> pa.Array:
    tok = _load(path)
    table = [""] * (max(tok.get_vocab(True).values()) + 1)
    for piece, k in tok.get_vocab(True).items():
        table[k] = piece
    return pa.array(table, pa.string())


def _pack(parts: list[np.ndarray | bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(bytes(x) for x in parts))


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def _count_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, found = _splitter(path), Counter()

        def handed() -> Iterator[pa.RecordBatch]:
            words, many = list(found.keys()), np.fromiter(found.values(), np.int64, len(found))
            found.clear()
            for at in range(0, len(words), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + ROWS], pa.string()), pa.array(many[at : at + ROWS])], names=["word", "n"])

        for batch in batches:
            for _, texts in chunks(batch.column(0)):
                for text in texts:
                    found.update(split(text))
                if len(found) >= COUNTED:
                    yield from handed()
        yield from handed()

    return run


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _word_tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(part.column(0).to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], names=["word", "n", "ids"])

    return run


def word_table(texts: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``(word, n, ids)``: every distinct word of the corpus once, how often it stands there, and its packed ids."""
    counted = texts.select(F.col(text_col).alias("text")).mapInArrow(lean(_count_words(tokenizer_path)), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).mapInArrow(lean(_encode_words(tokenizer_path)), "word string, n long, ids binary")


class _Codes(dict):
    """Numbers of words; a new word gets the next one."""

    def __missing__(self, word: str) -> int:
        self[word] = out = len(self)
        return out


_CODED = "block long, docs binary, number int, word string"


def _coded_blocks(path: str, frequent, block_bytes: int, id_type: pa.DataType):
    """Rows ``(block, docs)`` with the packed word numbers of a block's texts, and rows ``(block, number, word)`` of its rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = _splitter(path), {w: k for k, w in enumerate(frequent.value[0].to_pylist())}
        block = TaskContext.get().partitionId() << 32
        schema = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("number", pa.int32()), ("word", pa.string())])
        codes, ids, coded, size = _Codes(known), [], [], 0

        def handed() -> Iterator[pa.RecordBatch]:
            sink = pa.BufferOutputStream()
            own = pa.schema([("id", id_type)])
            with pa.ipc.new_stream(sink, own) as out:
                out.write_table(pa.table({"id": pa.chunked_array(ids, id_type)}, own))
            rows = sink.getvalue().to_pybytes()
            lengths = np.fromiter(map(len, coded), "<i8", len(coded))
            numbers = np.fromiter(chain.from_iterable(coded), "<u4", int(lengths.sum()))
            # Each byte of the numbers apart: the high ones are nearly all zero.
            planes = numbers.view(np.uint8).reshape(-1, 4).T.tobytes()
            docs = np.array([len(rows), len(lengths)], "<i8").tobytes() + _pack([rows, lengths, planes])
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([docs], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string())], schema=schema)
            rare = list(codes)[len(known) :]
            for at in range(0, len(rare), ROWS):
                some = rare[at : at + ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), block)), pa.nulls(len(some), pa.binary()), pa.array(np.arange(at, at + len(some), dtype=np.int32)), pa.array(some, pa.string())], schema=schema
                )

        for batch in batches:
            for part, texts in chunks(batch.column(1)):
                ids.append(batch.column(0)[part.start : part.stop])
                for text in texts:
                    words = split(text)
                    coded.append(np.fromiter(map(codes.__getitem__, words), "<u4", len(words)))
                    size += 4 * len(words) + 8
                if size >= block_bytes:
                    yield from handed()
                    codes, ids, coded, size, block = _Codes(known), [], [], 0, block + 1
        if coded:
            yield from handed()

    return run


def _join_pieces(path: str, packed: list[bytes | None]) -> pa.Array:
    """The pieces of each value's ids, joined by a space: a join of ids with the id-to-piece table, by position."""
    some = [x or b"" for x in packed]
    flat = pa.array(np.frombuffer(b"".join(some), "<u4"))
    ends = np.r_[0, np.cumsum([len(x) // 4 for x in some])].astype(np.int32)
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), pc.take(_pieces(path), flat)), " ")
    return pc.if_else(pa.array([x is None for x in packed], pa.bool_()), pa.scalar(None, pa.string()), texts)


def _assemble(path: str, frequent, decoded: bool, id_type: pa.DataType):
    """One block's rows: the ids of each text's words, from the frequent words' and the block's own rare words' ids."""

    def run(docs: pa.Table, coded: pa.Table) -> pa.Table:
        rare = coded.column("ids").take(pa.array(np.argsort(coded.column("number").to_numpy()))).to_pylist() if coded.num_rows else []
        packed = [*frequent.value[1].to_pylist(), *rare]
        length = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        start, table = np.cumsum(length) - length, np.frombuffer(b"".join(packed), "<u4")
        parts, out, texts = [], [], []
        for value in docs.column("docs").to_pylist():
            head, many = np.frombuffer(value[:16], "<i8").tolist()
            data = _unpack(value[16:])
            parts.extend(pa.ipc.open_stream(data[:head]).read_all().column(0).chunks)
            words = np.frombuffer(data[head : head + 8 * many], "<i8")
            numbers = np.ascontiguousarray(np.frombuffer(data[head + 8 * many :], np.uint8).reshape(4, -1).T).view("<u4").ravel()
            bounds, at = np.r_[0, np.cumsum(words)], 0
            while at < many:
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + ROWS, "right")) - 1)
                codes = numbers[bounds[at] : bounds[to]].astype(np.int64)
                ends = np.r_[0, np.cumsum(length[codes])]
                found = table[np.repeat(start[codes] - ends[:-1], length[codes]) + np.arange(ends[-1])]
                cuts = ends[bounds[at : to + 1] - bounds[at]].tolist()
                some = [found[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
                out.extend(some)
                if decoded:
                    texts.append(_join_pieces(path, some))
                at = to
        rows = {"id": pa.chunked_array(parts, id_type), "ids": pa.array(out, pa.binary())}
        return pa.table(rows | ({"decoded": pa.chunked_array(texts, pa.string())} if decoded else {}))

    return run


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, decoded: bool = False, frequent: int = FREQUENT) -> DataFrame:
    """``(id, ids)``: for each row of ``docs`` the ids of its whole text, packed.

    ``decoded`` adds a column of that name with what ``decode`` makes of the
    ids, in the same task. Blocks are written once before anything is joined
    to them, so a task that runs again finds the same blocks.
    """
    kind, spark = docs.schema[id_col].dataType, docs.sparkSession
    id_type = to_arrow_type(kind)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    words = materialize(word_table(slim, tokenizer_path), "words")
    # A histogram of counts, of some hundred bins, says how common a word must be for no more than ``frequent`` to be so.
    able = words.where(F.length("word") <= FREQUENT_CHARS).withColumn("bin", F.floor(F.log2("n") * 8).cast("int"))
    bins, left, least = able.groupBy("bin").agg(F.count("*").alias("m")).collect(), frequent, 1 << 30
    for r in sorted(bins, key=lambda r: -r["bin"]):
        left -= r["m"]
        if left < 0:
            break
        least = r["bin"]
    top = able.where(F.col("bin") >= least).select("word", "n", "ids").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    known = spark.sparkContext.broadcast((top.column("word").combine_chunks(), top.column("ids").combine_chunks()))
    del top
    blocks = slim.mapInArrow(lean(_coded_blocks(tokenizer_path, known, block_bytes, id_type)), _CODED)
    # Texts and rare words in folders of their own, as the words aren't needed for as long.
    path = scratch_path(spark, "blocks")
    with batches_bounded(spark):
        blocks.withColumn("kind", F.when(F.col("word").isNull(), "texts").otherwise("words")).write.mode("overwrite").partitionBy("kind").parquet(path)
    both = spark.read.schema(blocks.schema).parquet
    rare = both(f"{path}/kind=words") if path_exists(spark, f"{path}/kind=words") else blocks.limit(0)
    coded = materialize(rare.select("block", "number", "word").join(words.select("word", "ids"), "word").select("block", "number", "ids"), "coded")
    drop_materialized(words)
    remove_path(spark, f"{path}/kind=words")
    texts = both(f"{path}/kind=texts").select("block", "docs") if path_exists(spark, f"{path}/kind=texts") else blocks.limit(0).select("block", "docs")
    text = [T.StructField("decoded", T.StringType())] if decoded else []
    out = T.StructType([T.StructField("id", kind), T.StructField("ids", T.BinaryType()), *text])
    return texts.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(_assemble(tokenizer_path, known, decoded, id_type), out)


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its packed ids: their pieces, joined by a space.

    The id-to-piece table is the vocabulary (a fixed number of rows), read by
    each executor from ``tokenizer_path`` and joined by position. Special
    tokens are pieces like any other; null ids give null. A column named
    ``out_col`` is replaced.
    """
    if _load(tokenizer_path).decoder is not None:
        raise ValueError("only vocabularies whose pieces are joined by spaces are supported")
    encoded = encoded.drop(out_col) if out_col != ids_col else encoded
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _join_pieces(tokenizer_path, batch.column(at).to_pylist())], names=[*batch.schema.names, out_col])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())]))
