"""Token-id files: every id stored in the minimum number of bits of the
vocabulary, in blocks with byte offsets.

One file ("shard") holds a run of documents in ascending ``doc_id`` order::

    magic "FWTOK001"
    u32 bits, u32 block_ids, u64 n_docs, u64 n_ids, u64 n_blocks
    i64 doc_id[n_docs], u8 has_id[n_docs], i64 doc_start[n_docs + 1]
    i64 block_offset[n_blocks + 1]          bytes from the start of the payload
    payload                                  blocks of ``block_ids`` packed ids

Ids lie least significant bit first; eight ids fill exactly ``bits`` bytes,
so a block unpacks with a fixed number of numpy shifts and any block can be
read alone.  All integers are little-endian.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlex.llm.base import Memo, put_file, stored, work_path

MAGIC = b"FWTOK001"
HEAD = struct.Struct("<8sIIQQQ")
BLOCK_IDS = 65536        # ids of a block: a multiple of 8
SHARD_IDS = 4_000_000    # a shard is closed at the first document end past this
MEMO_BYTES = 256 << 20

MANIFEST = "part int, shard int, n_docs long, n_ids long, path string"
READ = "part int, shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


# ---- packing ---------------------------------------------------------------

def bits_for(vocab_size: int) -> int:
    """Minimum bits of an id below ``vocab_size``."""
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Pack ids of ``bits`` bits each, eight ids to ``bits`` bytes."""
    if bits in (8, 16, 32):
        n = -len(ids) % 8
        return np.pad(ids, (0, n)).astype(f"<u{bits // 8}").tobytes()
    x = np.pad(ids, (0, -len(ids) % 8)).astype(np.uint64).reshape(-1, 8)
    out = np.zeros((len(x), bits), np.uint8)
    for i in range(8):
        at = i * bits
        for k in range(at // 8, (at + bits - 1) // 8 + 1):
            shift = at - 8 * k
            part = x[:, i] << np.uint64(shift) if shift >= 0 else x[:, i] >> np.uint64(-shift)
            out[:, k] |= (part & np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def unpack(data, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a packed block, as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    b = np.frombuffer(data, np.uint8).reshape(-1, bits).astype(np.uint64)
    out = np.zeros((len(b), 8), np.uint64)
    for i in range(8):
        at = i * bits
        for k in range(at // 8, (at + bits - 1) // 8 + 1):
            shift = at - 8 * k
            out[:, i] |= b[:, k] >> np.uint64(shift) if shift >= 0 else b[:, k] << np.uint64(-shift)
    return (out & np.uint64((1 << bits) - 1)).astype(np.uint32).ravel()[:n]


def shard_bytes(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """One shard file."""
    starts = np.concatenate(([0], np.cumsum(lengths))).astype("<i8")
    blocks = [pack(ids[k:k + BLOCK_IDS], bits) for k in range(0, len(ids), BLOCK_IDS)]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<i8")
    return b"".join([
        HEAD.pack(MAGIC, bits, BLOCK_IDS, len(doc_ids), len(ids), len(blocks)),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array([d is not None for d in doc_ids], "u1").tobytes(),
        starts.tobytes(), offsets.tobytes(), *blocks])


class Shard:
    """Reader of one shard held in memory or memory-mapped."""

    def __init__(self, data):
        magic, self.bits, self.block_ids, self.n_docs, self.n_ids, n_blocks = HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a token-id shard")
        at = HEAD.size
        self.data = memoryview(data)
        ids = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        has = np.frombuffer(data, "u1", self.n_docs, at)
        at += self.n_docs
        self.starts = np.frombuffer(data, "<i8", self.n_docs + 1, at)
        at += 8 * (self.n_docs + 1)
        self.offsets = np.frombuffer(data, "<i8", n_blocks + 1, at)
        self.payload = at + 8 * (n_blocks + 1)
        self.doc_ids = [int(d) if h else None for d, h in zip(ids, has)]

    def block(self, b: int) -> np.ndarray:
        lo, hi = self.payload + int(self.offsets[b]), self.payload + int(self.offsets[b + 1])
        return unpack(self.data[lo:hi], self.bits, min(self.block_ids, self.n_ids - b * self.block_ids))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids at positions [start, stop): reads only the blocks they lie in."""
        first, last = start // self.block_ids, max(start, stop - 1) // self.block_ids
        got = [self.block(b) for b in range(first, last + 1)] if stop > start else [np.zeros(0, np.uint32)]
        return np.concatenate(got)[start - first * self.block_ids:stop - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


# ---- encoding --------------------------------------------------------------

class WordEncoder:
    """Ids of whole texts from the tokenizers library.

    A tokenizer whose pre-tokenizer never joins text across white space gives
    a text the ids of its white-space-separated words, one after another; a
    word seen lately is not encoded again.  Texts are split on ASCII white
    space only, which every such tokenizer treats as a boundary, and are
    lower-cased first where the tokenizer lower-cases anyway.  A new word of
    Latin letters and visible ASCII is cut into the tokenizer's own pre-tokens,
    which go straight to the library's BPE model, each once.
    """

    def __init__(self, tokenizer_json: bytes, memo: int = MEMO_BYTES):
        import json

        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_buffer(tokenizer_json)
        spec = json.loads(tokenizer_json)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special_low = [t.encode().lower() for t in self.special]
        self.model = self.tok.model
        self.lower = "Lowercase" in json.dumps(spec.get("normalizer"))
        self.by_word = drops_white_space(spec)
        self.plain = plain_lower(spec)
        self.cut = latin_pieces(spec) if self.by_word and self.plain else None
        self.stand_in = byte_letters()
        self.memo = Memo(self.new_word, memo)

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, low: str) -> bytes:
        """Ids of one lower-case pre-token."""
        return array("I", [t.id for t in self.model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(self.stand_in))]).tobytes()

    def new_word(self, w: bytes) -> bytes:
        if not self.cut:
            return self.whole(w.decode())
        if w.isalpha():  # ASCII letters
            low = w.lower()
            return self.piece(w.decode()) if low == w else self.memo[low]
        if w[-1] in MARKS and w[:-1].isalpha():
            return self.memo[w[:-1]] + self.memo[w[-1:]]
        text = w.decode()
        if not VISIBLE.fullmatch(text):
            return self.whole(text)
        low = text.lower()
        if any(s in text or s in low for s in self.special):
            return self.whole(text)
        if low != text:
            return self.memo[low.encode()]
        parts = self.cut(text)
        return self.piece(text) if parts == [text] else b"".join([self.memo[p.encode()] for p in parts])

    def lower_case(self, text: str, raw: bytes) -> bytes:
        """``raw``, the UTF-8 of ``text``, with ASCII letters in lower case if
        the library gives that the same ids: a letter may compose with a mark
        in one case only, and an added token is of one case."""
        low = raw.lower()
        if any(s in low for s in self.special_low):
            return raw
        if raw.isascii() or self.plain and is_normalized("NFC", text) and is_normalized("NFC", low.decode()):
            return low
        return raw

    def ids_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian uint32 bytes; null is the empty text."""
        if not text:
            return b""
        if not self.by_word:
            return self.whole(text)
        raw = text.encode()
        if self.lower:
            raw = self.lower_case(text, raw)
        return b"".join(map(self.memo.__getitem__, raw.split()))


LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017e"
MARKS = frozenset(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
VISIBLE = re.compile(f"[!-~{LATIN}]+")


def byte_letters() -> dict[int, int]:
    """Byte value -> printable stand-in of byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others for U+0100 onwards."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}


def plain_lower(spec: dict) -> bool:
    """True if normalisation is NFC, white space to blanks and lower case."""
    normalizer = spec.get("normalizer") or {}
    steps = normalizer.get("normalizers", [normalizer])
    others = [n for n in steps if n.get("type") not in ("NFC", "Lowercase")]
    return (steps[-1].get("type") == "Lowercase"
            and all(n.get("type") == "Replace" and n["pattern"].get("Regex") == "\\s+" and n["content"] == " " for n in others))


def latin_pieces(spec: dict):
    """The function that cuts a word of ``VISIBLE`` characters into pre-tokens
    that go byte by byte to a BPE model; None if the tokenizer has another
    pre-tokenizer, or an added token of letters with a mark behind at most."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if (len(steps) != 2 or steps[0].get("type") != "Split" or steps[1].get("type") != "ByteLevel" or steps[1].get("add_prefix_space")
            or steps[1].get("use_regex") or spec["model"].get("type") != "BPE" or spec["model"].get("dropout")):
        return None
    letters, plain = "[\\p{L}]+", {"[\\p{N}]", "[\\p{N}]+", "[^\\s\\p{L}\\p{N}]+"}
    pattern = steps[0]["pattern"].get("Regex", "")
    choices = pattern.split("|")
    if letters not in choices or any(c != letters and c not in plain and not re.fullmatch("'[a-z]+", c) for c in choices):
        return None
    if any(re.fullmatch(f"[{LATIN}]*[!-/:-@[-`{{-~]?", t["content"]) for t in spec.get("added_tokens", [])):
        return None
    return re.compile(pattern.replace("\\p{L}", LATIN).replace("\\p{N}", "0-9")).findall


def drops_white_space(spec: dict) -> bool:
    """True if white space is a boundary that leaves no token: some Split
    step removes all but the matches of a pattern without white space, or the
    pre-tokenizer is the plain white-space one; added tokens must neither
    contain nor strip white space."""
    pre = spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    first = steps[0] if steps else {}
    pattern = (first.get("pattern") or {}).get("Regex", " ")
    keeps = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" \
        and " " not in pattern and "\\s" not in pattern.replace("[^\\s", "")
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]))
                for t in spec.get("added_tokens", []))
    return bool((keeps or first.get("type") in ("Whitespace", "WhitespaceSplit")) and added)


_ENCODERS: dict = {}


def encoder(tokenizer_json: bytes) -> WordEncoder:
    """One encoder per Python worker and tokenizer file."""
    key = zlib.crc32(tokenizer_json)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(tokenizer_json)
    return _ENCODERS[key]


# ---- Spark -----------------------------------------------------------------

def write_token_files(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int,
                      vocab_size: int | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode ``docs(doc_id, text)``, append ``end_id`` to every document and
    write shards below ``out_dir``; returns the manifest
    (part, shard, n_docs, n_ids, path).

    Documents are range-partitioned and sorted by ``doc_id`` (repeated ids by
    a hash of the text; a null id sorts first), so part and shard numbers
    follow the order of ids.  Null text is the empty text; an empty table
    writes nothing.  A task holds one shard at a time.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    if vocab_size is None:
        from tokenizers import Tokenizer
        vocab_size = max(Tokenizer.from_buffer(data).get_vocab().values()) + 1
    bits = bits_for(max(vocab_size, end_id + 1))
    shipped = spark.sparkContext.broadcast(data)

    def write(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        enc = encoder(shipped.value)
        end = np.array([end_id], "<u4").tobytes()
        doc_ids, lengths, blobs, held, shard = [], [], [], 0, 0

        def close():
            ids = np.frombuffer(b"".join(blobs), "<u4")
            path = f"{out_dir}/part-{part:06d}-{shard:05d}.tok"
            put_file(path, shard_bytes(doc_ids, np.array(lengths, "<i8"), ids, bits))
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()),
                "n_docs": [len(doc_ids)], "n_ids": [len(ids)], "path": [path]})

        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                got = enc.ids_bytes(t.as_py()) + end
                doc_ids.append(d)
                lengths.append(len(got) // 4)
                blobs.append(got)
                held += lengths[-1]
                if held >= shard_ids:
                    yield close()
                    doc_ids, lengths, blobs, held, shard = [], [], [], 0, shard + 1
        if doc_ids:
            yield close()

    ordered = (docs.select("doc_id", "text")
               .withColumn("__tie", F.xxhash64("text"))
               .repartitionByRange("doc_id", "__tie")
               .sortWithinPartitions("doc_id", "__tie").drop("__tie"))
    return ordered.mapInArrow(write, MANIFEST)


def read_token_files(spark: SparkSession, out_dir: str) -> DataFrame:
    """One row per document read back from the shards: (part, shard, doc_id,
    local_start, n_tokens, ids_crc32)."""

    def read(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                part, shard = (int(x) for x in path.rsplit("/", 1)[1][len("part-"):-len(".tok")].split("-"))
                s = Shard(content.as_buffer())
                crc = []
                block, whole = -1, None
                for k in range(s.n_docs):
                    lo, hi, c = int(s.starts[k]), int(s.starts[k + 1]), 0
                    while lo < hi:  # block by block: a shard is never unpacked whole
                        if lo // s.block_ids != block:
                            block, whole = lo // s.block_ids, s.block(lo // s.block_ids).astype("<u4")
                        at = lo - block * s.block_ids
                        n = min(hi - lo, len(whole) - at)
                        c = zlib.crc32(whole[at:at + n].tobytes(), c)
                        lo += n
                    crc.append(c)
                n = s.n_docs
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int32()),
                    "doc_id": pa.array(s.doc_ids, pa.int64()), "local_start": s.starts[:-1].astype(np.int64),
                    "n_tokens": np.diff(s.starts).astype(np.int64), "ids_crc32": pa.array(crc, pa.int64())})

    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.tok")
             .schema("path string, modificationTime timestamp, length long, content binary").load(out_dir)
             .select("path", "content"))
    return files.mapInArrow(read, READ)


def shard_starts(manifest: DataFrame) -> DataFrame:
    """Ids before each shard.  Shards are numbered inside their part; only
    the per-part totals (one row per write task) go through one window."""
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("__n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = parts.select("part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return (manifest.withColumn("__in", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
            .join(offset, "part").select("part", "shard", (F.col("__off") + F.col("__in")).alias("shard_start")))


def token_file_digest(docs: DataFrame, tokenizer_path: str, end_id: int, out_dir: str | None = None,
                      shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write ``docs`` as token files and return what the files say about each
    document: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    out_dir = out_dir or work_path(spark, "token-files")
    manifest = stored(write_token_files(docs, out_dir, tokenizer_path, end_id, shard_ids=shard_ids), "token-manifest")
    if not manifest.head(1):  # no documents, no files
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    starts = shard_starts(manifest)
    return (read_token_files(spark, out_dir).join(starts, ["part", "shard"])
            .select("doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"))
