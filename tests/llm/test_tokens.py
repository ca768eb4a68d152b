"""Token files, SentencePiece coding and prefix counts against the public
libraries."""

import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from marketlex.llm import piece_viterbi, prefix_counts, token_files
from marketlex.llm.queries import BYTE_BPE, END_ID, PIECES, WORD_BPE
from tests.llm.conftest import EDGES

ODD = ["", " ", "  a  b\n\n 's don't 'reality x're \t\n'll", "<|endoftext|> a<|endoftext|>'s", "İÉẖ H̱ ΣΑΣ", "日本語 テスト 😀😀",
       "\x00\x1c\x85 a b", "=====--------     \n\n\n   x", "ab" * 300, "    " * 13, "x     y      z       w", "!'s ''t 'Re", "½ ² Ⅷ 12345 1,000.00"]


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2 ** bits, 1003).astype(np.uint32)
    data = token_files.pack(ids, bits)
    assert len(data) == -(-1003 // 8) * bits
    assert (token_files.unpack(data, bits, 1003) == ids).all()


def test_minimum_bits():
    assert [token_files.bits_for(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_shard_random_access(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 64)
    rng = np.random.default_rng(1)
    lengths = rng.integers(0, 200, 40)
    ids = rng.integers(0, 5000, lengths.sum()).astype(np.uint32)
    s = token_files.Shard(token_files.shard_bytes([None, *range(39)], lengths, ids, 13))
    starts = np.concatenate(([0], np.cumsum(lengths)))
    assert s.doc_ids == [None, *range(39)]
    for k in range(40):
        assert (s.document(k) == ids[starts[k]:starts[k + 1]]).all()
    assert (s.ids(100, 1000) == ids[100:1000]).all()


def word_ids(text):
    return Tokenizer.from_file(str(P.path(WORD_BPE))).encode(text or "", add_special_tokens=False).ids


def test_word_encoder_equals_library(texts):
    with open(P.path(WORD_BPE), "rb") as f:
        enc = token_files.WordEncoder(f.read(), memo=500)
    tok = Tokenizer.from_file(str(P.path(WORD_BPE)))
    assert enc.by_word
    for t in [*texts.values(), *ODD]:
        assert np.frombuffer(enc.ids_bytes(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_new_words_are_cut_into_pre_tokens_seen_before():
    """Marks around a word, and its case, must not send it through the whole
    tokenizer again: that took most of the time of packing and token files."""
    with open(P.path(WORD_BPE), "rb") as f:
        enc = token_files.WordEncoder(f.read())
    whole, looked_at = enc.whole, []
    enc.whole = lambda t: looked_at.append(t) or whole(t)
    t = "word Word, word*** (word) \"WORD's\" l'été État... 12,5 état! <<état>> state-of-the-art x=1;\n" * 2
    assert np.frombuffer(enc.ids_bytes(t), "<u4").tolist() == word_ids(t)
    assert looked_at == []
    assert sum(w.lower().startswith((b"word", "état".encode())) for w in enc.memo if w.decode().isalpha()) == 2


@pytest.mark.parametrize("change", [{}, {"normalizer": {"type": "Lowercase"}}, {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFD"}, {"type": "Lowercase"}]}},
                                    {"normalizer": {"type": "Sequence", "normalizers": [{"type": "Replace", "pattern": {"String": "!"}, "content": "?"}, {"type": "Lowercase"}]}},
                                    {"normalizer": None}, {"token": "bel"}, {"token": "l'"}, {"token": "s."}, {"token": "Été"}, {"token": "***"}])
def test_word_encoder_equals_library_on_odd_words(change):
    with open(P.path(WORD_BPE)) as f:
        spec = json.load(f)
    if "token" in change:
        spec["added_tokens"].append({**spec["added_tokens"][-1], "id": 50_000, "content": change["token"]})
    else:
        spec |= change
    raw = json.dumps(spec).encode()
    enc, tok = token_files.WordEncoder(raw, memo=50_000), Tokenizer.from_buffer(raw)
    rng = random.Random(7)
    parts = ["label", "Été", "ÉTÉ", "'s", "'LL", "s.", "***", "<|endoftext|>", "<|ENDOFTEXT|>", "\"", "'", "(", ")!", "12", "½", "²", "İ", "ẞ", "ΑΣ", "H\u0331", "I\u0307", "E\u0301",
             "ŉ", "’s", "日本", "😀", " ", " ", "\n", "\x1c", "\u00a0"]
    for t in [*ODD, *("".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(400))]:
        assert np.frombuffer(enc.ids_bytes(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def expected_files(rows):
    """Contract columns for rows in file order."""
    out, start = [], 0
    for d, t in rows:
        ids = word_ids(t) + [END_ID]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(small_docs, texts):
    got = token_files.token_file_digest(small_docs, str(P.path(WORD_BPE)), END_ID, shard_ids=20_000)
    assert sorted(map(tuple, got.collect())) == expected_files(sorted(texts.items()))


def test_token_files_edges(edges, none, spark):
    got = token_files.token_file_digest(edges, str(P.path(WORD_BPE)), END_ID).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted((d for d, _ in EDGES), key=lambda d: -1 if d is None else d)
    by_id = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got}
    assert by_id == {(d, n, c) for d, _, n, c in expected_files(EDGES)}
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([r.n_tokens for r in got])[:-1])).tolist()
    assert token_files.token_file_digest(none, str(P.path(WORD_BPE)), END_ID).collect() == []


# ---- prefix counts ---------------------------------------------------------

@pytest.fixture(scope="module")
def counter():
    with open(P.path(BYTE_BPE), "rb") as f:
        return prefix_counts.PrefixCounter(f.read())


@pytest.fixture(scope="module")
def byte_tok():
    return Tokenizer.from_file(str(P.path(BYTE_BPE)))


def test_every_prefix_is_exact(counter, byte_tok, texts):
    for t in [x[:150] for x in list(texts.values())[:25]] + ODD:
        counts = np.concatenate(([0], np.cumsum(counter.deltas(t))))
        assert counts.tolist() == [len(byte_tok.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]


def test_stable_pairs_equal_merging(counter):
    rng = np.random.default_rng(2)
    tokens = sorted(counter.tokens)
    pairs = [(tokens[a], tokens[b]) for a, b in rng.integers(0, len(tokens), (3000, 2))] + [(t, t) for t in tokens[::200]]
    pairs += [(t[:k], t[k:]) for t in tokens[::50] for k in range(1, len(t)) if t[:k] in counter.tokens and t[k:] in counter.tokens]
    for a, b in pairs:
        assert counter.stays_apart(a, b) == (counter.merge(a + b) == [a, b]), (a, b)


def test_stored_table_answers(counter, byte_tok):
    t = "Some words, a number 12345 and   blanks\n\nthen more words. " * 5
    counts = prefix_counts.prefix_table(prefix_counts.store(counter.deltas(t)))
    n = len(byte_tok.encode(t, add_special_tokens=False).ids)
    assert prefix_counts.count_at(counts, len(t)) == prefix_counts.count_at(counts, 10 ** 6) == n
    cut = prefix_counts.longest_prefix(counts, 20)
    assert counts[cut] <= 20 and (counts[cut + 1:] > 20).all()
    assert prefix_counts.longest_prefix(counts, 0) == 0 and prefix_counts.longest_prefix(counts, n) == len(t)


def test_token_counts(edges, none, byte_tok):
    got = prefix_counts.token_counts(edges, str(P.path(BYTE_BPE)), budget=50, keep_table=True).collect()
    assert len(got) == len(EDGES)
    for r, (d, t) in zip(got, EDGES):
        n = len(byte_tok.encode(t or "", add_special_tokens=False).ids)
        assert (r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) == (d, len((t or "").encode()), n, n > 50)
        assert prefix_counts.prefix_table(r.prefix_table)[-1] == n
    assert prefix_counts.token_counts(none, str(P.path(BYTE_BPE))).collect() == []


# ---- SentencePiece ---------------------------------------------------------

@pytest.fixture(scope="module")
def pieces():
    with open(P.path(PIECES), "rb") as f:
        return piece_viterbi.PieceModel(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=str(P.path(PIECES)))


def test_encode_and_decode_equal_library(pieces, library, texts):
    for t in [*texts.values(), *ODD, "a▁b ▁▁▁▁▁ c"]:
        ids = pieces.encode(t)
        assert ids == library.encode(t)
        assert pieces.decode(ids) == library.decode(ids)
        assert "▁" in t or pieces.decode(ids) == t


def test_unigram_model_takes_the_best_path(library):
    """The same pieces as a unigram model: the library's own Viterbi is the
    oracle."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    with open(P.path(PIECES), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    rng = np.random.default_rng(3)
    for p in m.pieces:
        if p.type == piece_viterbi.NORMAL:
            p.score = -float(rng.uniform(3, 6)) - 6.0 / len(p.piece)
    raw = m.SerializeToString()
    ours, theirs = piece_viterbi.PieceModel(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for t in ["some words here", "international business", "a b c", "unbelievable things happen. twice, even"]:
        assert ours.encode(t) == theirs.encode(t)


def test_encode_decode(edges, none, library):
    got = piece_viterbi.encode_decode(edges, str(P.path(PIECES))).collect()
    for r, (d, t) in zip(got, EDGES):
        assert (r.doc_id, list(r.piece_ids)) == (d, library.encode(t or ""))
        assert r.n_pieces == len(r.piece_ids) and r.round_trip and r.n_chars_decoded == len(t or "")
        assert r.ids_crc32 == zlib.crc32(np.array(r.piece_ids, "<u4").tobytes())
    assert piece_viterbi.encode_decode(none, str(P.path(PIECES))).collect() == []


def test_query_returns_ids_and_decoded_texts(spark, edges, library, tmp_path):
    from marketlex.llm.queries import op5_sentencepiece
    edges.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.doc_id, list(r.piece_ids), r.decoded) for r in op5_sentencepiece(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(((d, library.encode(t or ""), t or "") for d, t in EDGES), key=repr)
