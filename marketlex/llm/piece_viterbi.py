"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the
pieces drives a single-pass Viterbi.

The automaton reports, at every position, all pieces that end there (it
follows its output links); each relaxes the best score at its end from the
best score at its start.  For a *unigram* model that is the whole rule.  A
*BPE* model ranks merges instead of scoring segmentations: there an edge may
only follow a piece next to which it is stable (merging the two pieces'
characters gives the two pieces back), which leaves exactly one path, the
model's own encoding.  Characters without a piece fall back to their byte
pieces.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marketlex.llm.base import Memo

BLANK = "▁"
MEMO_BYTES = 224 << 20   # of chunks; half of it of piece pairs
BATCH_IDS = 1 << 20      # ids of one batch of rows
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the public model format


class PieceModel:
    def __init__(self, model_bytes: bytes, memo: int = MEMO_BYTES):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb
        m = pb.ModelProto()
        m.ParseFromString(model_bytes)
        norm = m.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or any(p.type == USER for p in m.pieces):
            raise ValueError("only models with identity normalisation and no user-defined pieces")
        self.bpe = m.trainer_spec.model_type == 2
        self.dummy_prefix = norm.add_dummy_prefix
        self.unk = next(k for k, p in enumerate(m.pieces) if p.type == UNKNOWN)
        normal = [(k, p.piece, p.score) for k, p in enumerate(m.pieces) if p.type == NORMAL]
        self.score = {s: x for _, s, x in normal}
        self.byte_id = {int(p.piece[3:5], 16): k for k, p in enumerate(m.pieces) if p.type == BYTE}
        low = min((x for _, _, x in normal), default=0.0)
        self.unk_score = low - 10.0
        self.halves: dict = {}            # the two parts whose merge makes a piece
        self.stable = Memo(lambda pair: self.stays_apart(*pair), memo // 2)
        usable = [(k, s, x) for k, s, x in normal if not self.bpe or len(s) == 1 or self.merge(s, True) == [s]]
        self.automaton = ahocorasick.Automaton()
        for k, s, x in usable:
            self.automaton.add_word(s, (len(s), k, x, s))
        self.automaton.make_automaton()
        # what decoding writes for each id
        text_of = [b"" if p.type in (CONTROL,) else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE
                        else " ⁇ ".encode() if p.type == UNKNOWN else p.piece.replace(BLANK, " ").encode() for p in m.pieces]
        self.length_of = np.array([len(t) for t in text_of], np.int64)
        self.start_of = np.cumsum(self.length_of) - self.length_of
        self.all_text = np.frombuffer(b"".join(text_of), np.uint8)
        # no piece crosses these places, so a text falls into independent chunks
        inner = any(BLANK in s.lstrip(BLANK) for _, s, _ in normal)
        lone_newline = not any("\n" in s and len(s) > 1 for _, s, _ in normal)
        self.chunk = None if inner else re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n" if lone_newline else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        # a mark after a letter never joins it
        joined = {s[k + 1] for _, s, _ in normal for k in range(len(s) - 1) if s[k].isalpha()}
        self.marks = "".join(c for c in ",.;:!?" if c not in joined)
        self.chunks = Memo(self.new_chunk, memo)

    def new_chunk(self, c: str) -> bytes:
        if len(c) > 1 and c[-1] in self.marks and c[-2].isalpha():
            return self.chunks[c[:-1]] + self.chunks[c[-1]]
        return array("I", self.viterbi(c)).tobytes()

    def merge(self, s: str, note: bool = False) -> list[str]:
        """The model's merge rule on a short string: always the best-scored
        piece that two neighbours make, the leftmost first.  ``note`` keeps
        the two parts that made the whole string."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                x = self.score.get(parts[k] + parts[k + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, k
            if at < 0:
                break
            if note and len(parts) == 2:
                self.halves[s] = (parts[0], parts[1])
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays_apart(self, a: str, b: str) -> bool:
        """True if merging the characters of two pieces gives the two back:
        taken apart latest merge first, no touching parts have a merge that
        comes before the one undone last.  Runs of blanks, whose pieces tie,
        are merged outright."""
        if a[-1] == BLANK and b[0] == BLANK:
            return self.merge(a + b) == [a, b]
        score, halves = self.score, self.halves
        limit, closed = -float("inf"), False   # a joining merge must beat this score
        while True:
            x = score.get(a + b)
            if x is not None and (x > limit or closed and x == limit):
                return False
            first_left = a in halves and (b not in halves or score[a] < score[b])
            if first_left:
                limit, closed, a = score[a], False, halves[a][1]
            elif b in halves:  # at a tie the left merge comes first
                limit, closed, b = score[b], True, halves[b][0]
            else:
                return True

    def viterbi(self, s: str) -> list[int]:
        """Ids of one chunk: single pass over the automaton's matches."""
        n = len(s)
        best: list = [None] * (n + 1)    # best score up to each position
        best[0] = 0.0
        start, ids, piece_at = [0] * (n + 1), [-1] * (n + 1), [None] * (n + 1)
        bpe, stable, done = self.bpe, self.stable, 0
        for end, (length, k, x, piece) in self.automaton.iter(s):
            while done < end:  # all matches up to here seen: no piece reaches it, an unknown character does
                done += 1
                if best[done] is None and best[done - 1] is not None:
                    best[done], start[done] = best[done - 1] + self.unk_score, done - 1
            at = end + 1 - length
            score = best[at]
            if score is None or bpe and piece_at[at] is not None and not stable[piece_at[at], piece]:
                continue
            score += x
            end += 1
            if best[end] is None or score > best[end]:
                best[end], start[end], ids[end], piece_at[end] = score, at, k, piece
        while done < n:
            done += 1
            if best[done] is None and best[done - 1] is not None:
                best[done], start[done] = best[done - 1] + self.unk_score, done - 1
        out, at = [], n
        while at > 0:
            out.extend((ids[at],) if ids[at] >= 0 else reversed(self.fallback(s[start[at]:at])))
            at = start[at]
        return out[::-1]

    def fallback(self, c: str) -> list[int]:
        raw = c.encode()
        return [self.byte_id[b] for b in raw] if all(b in self.byte_id for b in raw) else [self.unk]

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a text as little-endian uint32 bytes; null and empty: none."""
        if not text:
            return b""
        s = (BLANK if self.dummy_prefix else "") + text.replace(" ", BLANK)
        if self.chunk is None:
            return array("I", self.viterbi(s)).tobytes()
        return b"".join(map(self.chunks.__getitem__, self.chunk.findall(s)))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids) -> str:
        """Text of ids: pieces joined, byte pieces as UTF-8, blank marks as
        spaces, without the dummy prefix."""
        ids = np.asarray(ids, np.int64)
        n = self.length_of[ids]
        ends = np.cumsum(n)
        flat = np.repeat(self.start_of[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        s = self.all_text[flat].tobytes().decode(errors="replace")
        return s[1:] if self.dummy_prefix and s.startswith(" ") else s


_MODELS: dict = {}


def piece_model(model_bytes: bytes) -> PieceModel:
    key = zlib.crc32(model_bytes)
    if key not in _MODELS:
        _MODELS[key] = PieceModel(model_bytes)
    return _MODELS[key]


def encode_decode(docs: DataFrame, model_path: str, keep_ids: bool = True, keep_text: bool = False) -> DataFrame:
    """Encode every whole text of ``docs(doc_id, text)`` and decode the ids
    again: (doc_id, n_pieces, n_byte_pieces, ids_crc32, n_chars_decoded,
    round_trip[, piece_ids][, decoded]).

    ``round_trip`` tells whether decoding gives the text back (it does unless
    the text itself holds the blank mark).  Null and empty texts have no
    pieces and decode to the empty text; rows are kept one to one."""
    with open(model_path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        m = piece_model(shipped.value)
        is_byte = np.zeros(len(m.length_of), bool)
        is_byte[list(m.byte_id.values())] = True
        names = ("n_pieces", "n_byte_pieces", "ids_crc32", "n_chars_decoded", "round_trip")

        def batch(ids_of_rows, cols, blobs, texts):
            out = {"doc_id": ids_of_rows} | {k: pa.array(v, pa.bool_() if k == "round_trip" else pa.int64()) for k, v in cols.items()}
            if keep_ids:
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in blobs]))).astype("<i4")
                out["piece_ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), "<i4")))
            if keep_text:
                out["decoded"] = pa.array(texts, pa.string())
            return pa.RecordBatch.from_pydict(out)

        for b in batches:
            cols, blobs, texts, at, held = {k: [] for k in names}, [], [], 0, 0
            for k, t in enumerate(b.column("text")):
                t = t.as_py() or ""
                raw = m.encode_bytes(t)
                ids = np.frombuffer(raw, "<u4")
                back = m.decode(ids)
                cols["n_pieces"].append(len(ids))
                cols["n_byte_pieces"].append(int(is_byte[ids].sum()))
                cols["ids_crc32"].append(zlib.crc32(raw))
                cols["n_chars_decoded"].append(len(back))
                cols["round_trip"].append(back == t)
                if keep_ids:
                    blobs.append(raw)
                if keep_text:
                    texts.append(back)
                if keep_ids or keep_text:
                    held += len(ids)
                    if held > BATCH_IDS:
                        yield batch(b.column("doc_id").slice(at, k + 1 - at), cols, blobs, texts)
                        cols, blobs, texts, at, held = {k: [] for k in names}, [], [], k + 1, 0
            if at < b.num_rows:
                yield batch(b.column("doc_id").slice(at), cols, blobs, texts)

    schema = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, n_chars_decoded long, round_trip boolean"
    schema += (", piece_ids array<int>" if keep_ids else "") + (", decoded string" if keep_text else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
