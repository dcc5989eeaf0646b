"""URL rules by a sorted digest array.

The rules' strings (host and path) are hashed to 64-bit keys, sorted and
written with the strings to two files that every executor fetches and maps
into memory. A url asks for each of its host's suffixes with each of its path's
prefixes of a length that some rule has; a batch's keys are probed by one
vectorised binary search, and a hit counts only if the stored string is the
same, so colliding keys decide nothing. The longest rule wins; of rules as long
as each other that with the longer host, and of one rule with both verdicts
block. Urls that no rule fits are allowed. A rule with a null host, path or
verdict is no rule, nor is one whose path doesn't begin with ``/``: no url's
path could begin with it.

Null urls and urls without ``://`` have an empty host and path, which no rule
fits. Rows are judged one by one, repeated ones alike.
"""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontospark.llm.words import fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of rules up to which each executor maps them all; beyond, candidates are joined to the rules.
INDEX_BYTES = 1 << 26
#: Between a rule's host and path in the index.
SEP = "\0"


def with_host_and_path(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with ``host`` (A-Z lower-cased) and ``path``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return urls.withColumns(
        {
            "host": F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER),
            "path": F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1),
        }
    )


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode())


def write_index(rules: list[tuple[str, str, str]], folder: str) -> None:
    """``(host, path, verdict)`` rules as ``keys.npy`` (sorted), and the strings, verdicts and path lengths beside them."""
    best: dict[str, str] = {}
    for host, path, verdict in rules:
        best[host + SEP + path] = "block" if "block" in (verdict, best.get(host + SEP + path)) else "allow"
    strings = sorted(best, key=_key)
    blob = [s.encode() for s in strings]
    np.save(f"{folder}/keys.npy", np.array([_key(s) for s in strings], np.uint64))
    np.save(f"{folder}/ends.npy", np.cumsum([0, *map(len, blob)]).astype(np.int64))
    np.save(f"{folder}/bytes.npy", np.frombuffer(b"".join(blob), np.uint8))
    np.save(f"{folder}/blocks.npy", np.array([best[s] == "block" for s in strings], bool))
    np.save(f"{folder}/lengths.npy", np.array(sorted({len(p) for _, p, _ in rules}), np.int64))


class Index:
    def __init__(self, folder: str):
        self.keys, self.ends, self.bytes, self.blocks = (np.load(f"{folder}/{n}.npy", mmap_mode="r") for n in ("keys", "ends", "bytes", "blocks"))
        self.lengths = np.load(f"{folder}/lengths.npy").tolist()

    def string(self, k: int) -> str:
        return self.bytes[self.ends[k] : self.ends[k + 1]].tobytes().decode()

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str]]:
        """The winning rule and the verdict of each url."""
        owners, texts = [], []
        for k, (host, path) in enumerate(zip(hosts, paths)):
            for suffix in suffixes(host):
                for n in self.lengths:
                    if n > len(path):
                        break
                    owners.append(k)
                    texts.append(suffix + SEP + path[:n])
        out: list[tuple[str | None, str]] = [(None, "allow")] * len(hosts)
        if not len(self.keys) or not texts:
            return out
        keys = np.fromiter(map(_key, texts), np.uint64, len(texts))
        at = np.searchsorted(self.keys, keys)
        for c in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys).tolist():
            k = int(at[c])
            while k < len(self.keys) and self.keys[k] == keys[c]:
                if self.string(k) == texts[c]:
                    rule, _ = out[owners[c]]
                    if rule is None or len(texts[c]) > len(rule) + 1:  # longer hosts come first
                        out[owners[c]] = (texts[c].replace(SEP, ""), "block" if self.blocks[k] else "allow")
                    break
                k += 1
        return out


def suffixes(host: str) -> list[str]:
    parts = host.split(".") if host else []
    return [".".join(parts[k:]) for k in range(len(parts))]


@functools.lru_cache(8)
def _index(names: tuple[str, ...]) -> Index:
    found = [SparkFiles.get(n) for n in names]
    folder = tempfile.mkdtemp(prefix="urlrules-")
    for path in found:
        os.symlink(path, f"{folder}/{os.path.basename(path).partition('-')[2]}")
    return Index(folder)


def _ship(spark: SparkSession, rules: list[tuple[str, str, str]]) -> tuple[str, ...]:
    """Write the index and have Spark give its files to every executor, later ones too."""
    folder, tag, names = tempfile.mkdtemp(prefix="urlrules-"), uuid.uuid4().hex, []
    write_index(rules, folder)
    for name in sorted(os.listdir(folder)):
        os.rename(f"{folder}/{name}", f"{folder}/{tag}-{name}")
        spark.sparkContext.addFile(f"{folder}/{tag}-{name}")
        names.append(f"{tag}-{name}")
    atexit.register(shutil.rmtree, folder, True)  # the driver serves the files from here
    return tuple(names)


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``verdict``; columns of those names are replaced.

    ``rules`` has ``host``, ``path`` and ``verdict``. Above ``index_bytes`` of
    rules, the candidates of distinct urls are joined to the rules instead; the
    result is the same. Any other verdict than allow or block is an error.
    """
    rules = rules.select("host", "path", "verdict").dropna().where((F.col("path") == "") | F.col("path").startswith("/"))
    odd = rules.where(~F.col("verdict").isin("allow", "block")).head()
    if odd:
        raise ValueError(f"no such verdict: {odd['verdict']}")
    size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 17).alias("b")).first()["b"] or 0
    split = with_host_and_path(urls.drop(*({"host", "path", "rule", "verdict"} - {url_col})), url_col)
    if size > index_bytes:
        return _joined(split, rules)
    names = _ship(urls.sparkSession, [tuple(r) for r in rules.select("host", "path", "verdict").collect()])
    h, p = split.columns.index("host"), split.columns.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(names)
        for batch in batches:
            found = index.judge(batch.column(h).to_pylist(), batch.column(p).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], names=[*batch.schema.names, "rule", "verdict"]
            )

    return split.mapInArrow(run, T.StructType([*split.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]))


def _joined(split: DataFrame, rules: DataFrame) -> DataFrame:
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]
    host, path, rule, n = fresh(split.columns, "u_host", "u_path", "rule", "n")
    distinct = split.select(F.col("host").alias(host), F.col("path").alias(path)).distinct()
    labels = F.split(host, r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    each = distinct.where(F.col(host) != "").select(host, path, suffix.alias("s"))
    each = each.withColumn(n, F.explode(F.array(*[F.lit(k) for k in lengths]))).where(F.length(path) >= F.col(n))
    each = each.select(host, path, F.col("s").alias("r_host"), F.substr(path, F.lit(1), F.col(n)).alias("r_path"))
    single = rules.groupBy(F.col("host").alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("r_verdict"))
    order = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"))
    best = each.join(single, ["r_host", "r_path"]).groupBy(host, path).agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "r_verdict"), order).alias(rule))
    out = split.join(best, (split["host"] == best[host]) & (split["path"] == best[path]), "left")
    own = [split[c] for c in split.columns]
    return out.select(*own, best[rule]["rule"].alias("rule"), F.coalesce(best[rule]["r_verdict"], F.lit("allow")).alias("verdict"))
