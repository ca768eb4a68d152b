"""Exact token counts at every prefix of a text, by prefix dynamic
programming over a byte-level BPE vocabulary.

Inside one pre-token, the encoding of a prefix ends with exactly one token
``t`` that (a) is a suffix of the prefix and (b) is *stable* next to the last
token of the encoding of what precedes it: encoding the two tokens' bytes
gives those two tokens back.  So ``count[i] = count[i - len(t)] + 1`` walks a
pre-token once and yields the count of each of its prefixes.  Pre-tokens are
independent of each other, hence the counts of a text are a running sum of
per-pre-token differences; units seen lately are not walked again.
"""

from __future__ import annotations

import json
import zlib
from array import array
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from marketlex.llm.base import Memo

MEMO_BYTES = 224 << 20   # of pre-tokens; half of it of token pairs

# Byte-level pre-tokenisation (public GPT-2 rule): contractions, then letters /
# digits / other with at most one leading blank, then white space that leaves
# its last character to the next word.  A unit is a run of white space with
# the piece that follows it, so that a cut anywhere changes only its own unit.
WS = r"[\p{White_Space}]"
UNIT = regex.compile(
    rf"(?:{WS}*(?! ){WS})?'(?:s|t|re|ve|m|ll|d)"
    rf"|{WS}*(?:\p{{L}}+|\p{{N}}+|[^\p{{White_Space}}\p{{L}}\p{{N}}]+)|{WS}+")
SPACE_RUN = regex.compile(rf"{WS}*")
CONTRACTION = regex.compile(r"'(?:s|t|re|ve|m|ll|d)")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 byte values: printable Latin-1
    bytes stand for themselves, the others for U+0100 onwards in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    def __init__(self, tokenizer_json: bytes, memo: int = MEMO_BYTES):
        spec = json.loads(tokenizer_json)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
            raise ValueError("a byte-level BPE tokenizer without normaliser is needed")
        alphabet = byte_alphabet()

        def raw(s):
            return bytes(alphabet[c] for c in s)

        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.order = {bytes([b]): b - 256 for b in range(256)}   # place of the merge that makes a token
        self.halves = {}                                         # the two tokens of that merge
        for (a, b), k in self.rank.items():
            if self.order.setdefault(a + b, k) == k:
                self.halves[a + b] = (a, b)
        self.stable = Memo(lambda pair: self.stays_apart(*pair), memo // 2)
        self.tokens = {t for t in (raw(s) for s in spec["model"]["vocab"] if s not in self.special) if len(t) == 1 or self.reaches(t)}
        self.longest = max(map(len, self.tokens))
        self.units = Memo(self.unit_deltas, memo)

    def merge(self, b: bytes) -> list[bytes]:
        """Plain BPE of a short byte string."""
        parts = [b[k:k + 1] for k in range(len(b))]
        while len(parts) > 1:
            best = min((self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and self.rank.get((parts[k], parts[k + 1])) == best:
                    out.append(parts[k] + parts[k + 1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def stays_apart(self, a: bytes, b: bytes) -> bool:
        """True if encoding the bytes of two tokens gives the two back.

        Merging the bytes makes both tokens unless an earlier merge joins
        their touching parts first; so take the two apart, latest merge
        first, and look at each pair of touching parts for a merge that comes
        before the one undone last."""
        limit = 1 << 60
        while True:
            if self.rank.get((a, b), limit) < limit:
                return False
            for left in (True, False) if self.order[a] > self.order[b] else (False, True):
                if left and a in self.halves:
                    limit, a = self.order[a], self.halves[a][1]
                    break
                if not left and b in self.halves:
                    limit, b = self.order[b] + 1, self.halves[b][0]
                    break
            else:
                return True

    def reaches(self, t: bytes) -> bool:
        """True if some merge makes ``t`` and encoding its bytes gives it."""
        return any((t[:k], t[k:]) in self.rank for k in range(1, len(t))) and (len(t) < 3 or self.merge(t) == [t])

    def piece_counts(self, piece: bytes) -> list[int]:
        """Token count of every byte prefix of one pre-token (index 0: 0)."""
        tokens, stable, longest = self.tokens, self.stable, self.longest
        count, last = [0], [b""]
        for i in range(1, len(piece) + 1):
            for at in range(i - 1, max(-1, i - longest - 1), -1):  # exactly one suffix token fits
                t = piece[at:i]
                if t in tokens and (not at or stable[last[at], t]):
                    break
            count.append(count[at] + 1)
            last.append(t)
        return count

    def char_counts(self, piece: str) -> list[int]:
        """Token count of every code-point prefix of one pre-token."""
        by_byte = self.piece_counts(piece.encode())
        if len(by_byte) == len(piece) + 1:
            return by_byte
        at, out = 0, [0]
        for c in piece:
            at += len(c.encode())
            out.append(by_byte[at])
        return out

    def unit_deltas(self, unit: str) -> bytes:
        """int16 change of the prefix count at each code point of a unit."""
        if unit[0] == " " and unit[1:].isalpha():  # the usual unit: a blank and a word
            counts = self.char_counts(unit)
            return array("h", map(sub, counts[1:], counts)).tobytes()
        k = SPACE_RUN.match(unit).end()
        run, word = unit[:k], unit[k:]
        counts = self.char_counts(run) if k else [0]
        if word:
            base = 0
            if run:
                joined = " " if run[-1] == " " else ""
                base += self.char_counts(run[:-1])[-1] if k > 1 else 0
                base += 0 if joined else self.char_counts(run[-1])[-1]
                word = joined + word
                inner = self.char_counts(word)[1 + len(joined):]
            else:
                inner = self.char_counts(word)[1:]
            if len(word) > 2 and CONTRACTION.fullmatch(word):  # cut inside: the quote and letters part
                inner[1] = inner[0] + self.char_counts(word[1:2])[-1]
            counts = counts + [base + c for c in inner]
        return array("h", map(sub, counts[1:], counts)).tobytes()

    def deltas(self, text: str | None) -> np.ndarray:
        """Change of the count at each code point of a whole text; the
        running sum is the exact token count of every prefix."""
        if not text:
            return np.zeros(0, "<i2")
        if self.split_special is None or not any(s in text for s in self.special):
            return np.frombuffer(b"".join(map(self.units.__getitem__, UNIT.findall(text))), "<i2")
        out = []
        parts = self.split_special.split(text)
        for k, part in enumerate(parts):
            if k % 2 == 0:
                out.append(b"".join(map(self.units.__getitem__, UNIT.findall(part))))
            else:  # one token; a cut inside it is ordinary text after the last unit
                units = UNIT.findall(parts[k - 1])
                tail = units[-1] if units else ""
                before = self.plain_count(tail)
                counts = [0] + [self.plain_count(tail + part[:j]) - before for j in range(1, len(part))] + [1]
                out.append(np.diff(np.array(counts)).astype("<i2").tobytes())
        return np.frombuffer(b"".join(out), "<i2")

    def plain_count(self, text: str) -> int:
        return sum(int(np.frombuffer(self.units[u], "<i2").sum()) for u in UNIT.findall(text))


# ---- questions answered from a stored table --------------------------------

def store(deltas: np.ndarray) -> bytes:
    """The table as bytes: compressed int16 differences."""
    return zlib.compress(deltas.astype("<i2").tobytes(), 1)


def prefix_table(stored_bytes: bytes) -> np.ndarray:
    """Counts of all prefixes, index 0 for the empty one."""
    d = np.frombuffer(zlib.decompress(stored_bytes), "<i2")
    return np.concatenate(([0], np.cumsum(d, dtype=np.int64)))


def count_at(counts: np.ndarray, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` code points."""
    return int(counts[min(n_chars, len(counts) - 1)])


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else -1


_COUNTERS: dict = {}


def counter(tokenizer_json: bytes) -> PrefixCounter:
    key = zlib.crc32(tokenizer_json)
    if key not in _COUNTERS:
        _COUNTERS[key] = PrefixCounter(tokenizer_json)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, tokenizer_path: str, budget: int = 1024, keep_table: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, keep_chars[, prefix_table]) of
    every whole text of ``docs(doc_id, text)``.

    ``keep_chars`` is the length in code points of the longest prefix of at
    most ``budget`` tokens; ``prefix_table`` the stored counts of all
    prefixes.  Null text counts as empty (0 bytes, 0 tokens); rows are kept
    one to one, repeated or not.  No shuffle."""
    with open(tokenizer_path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches):
        c = counter(shipped.value)
        for b in batches:
            n_bytes, n_tokens, keep, tables = [], [], [], []
            for t in b.column("text"):
                t = t.as_py()
                d = c.deltas(t)
                counts = np.cumsum(d, dtype=np.int32)
                total = int(counts[-1]) if len(counts) else 0
                n_bytes.append(len(t.encode()) if t else 0)
                n_tokens.append(total)
                # the count can fall by a token at a later character, so look at all prefixes
                over = np.flatnonzero(counts <= budget)
                keep.append(int(over[-1]) + 1 if len(over) else 0)
                if keep_table:
                    tables.append(store(d))
            out = {"doc_id": b.column("doc_id"), "n_bytes": pa.array(n_bytes, pa.int64()),
                   "n_tokens": pa.array(n_tokens, pa.int64()),
                   "over_limit": pa.array([n > budget for n in n_tokens], pa.bool_()),
                   "keep_chars": pa.array(keep, pa.int64())}
            if keep_table:
                out["prefix_table"] = pa.array(tables, pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, keep_chars long"
    return docs.select("doc_id", "text").mapInArrow(count, schema + (", prefix_table binary" if keep_table else ""))
