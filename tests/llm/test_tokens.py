"""Token files, BPE and chat formatting against the tokenizers library and exact round trips."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactlane.llm import bpe, chat, token_files
from pactlane.llm.pieces import pieces


@pytest.fixture(scope="module")
def library(bpe_file):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_file)


def odd_texts(n=3000):
    rng = random.Random(1)
    alphabet = [*" \n\t\r'abcdefst012.,<|>endoftxé漢字\u00a0\u2003\x1c\x85\u200b🙂ñ", "<|endoftext|>", "'ll", "'s", "  ", "\n\n", "aaaa"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def split(ids, counts):
    edge = np.concatenate(([0], np.cumsum(counts)))
    return [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)]


def test_pieces_rebuild_the_text():
    for t in odd_texts():
        assert "".join(pieces(t)) == t


def test_backtracking_equals_the_library(bpe_file, library, texts):
    own = bpe.Coder(bpe_file)
    every = odd_texts() + [t for t in texts if t] + ["a" * 3000, "ab" * 500, "é" * 99]
    ids, counts = own.encode(every)
    want = [e.ids for e in library.encode_batch(every, add_special_tokens=False)]
    assert split(ids, counts) == want
    assert [t.decode() for t in own.decode(ids, counts)] == [library.decode(i, skip_special_tokens=False) for i in want]
    table = token_files.Encoder(bpe_file).table
    assert table.ids([t.encode() for t in every])[0].tolist() == ids.tolist()
    table.limit = 40  # pieces make room for others all the time
    for at in range(0, len(every), 7):
        some = [t.encode() for t in every[at : at + 7]]
        assert table.ids(some)[0].tolist() == [i for t in every[at : at + 7] for i in library.encode(t, add_special_tokens=False).ids]


def test_merges_by_definition(bpe_file):
    own = bpe.Coder(bpe_file)
    rng = random.Random(9)

    def merged(word):
        tokens = [own.id_of[c] for c in word]
        while True:
            ranks = [(own.pair.get(p, 1 << 60), k) for k, p in enumerate(zip(tokens, tokens[1:], strict=False))]
            if not ranks or min(ranks)[0] == 1 << 60:
                return tokens
            k = min(ranks)[1]
            pair = own.pair[tokens[k], tokens[k + 1]]
            whole = next(t for t, p in own.parts.items() if p[2] == pair)
            tokens[k : k + 2] = [whole]

    for _ in range(60):
        word = "".join(rng.choice("theinrs") for _ in range(rng.randint(1, 9)))
        assert own.encode_word(word) == merged(word)


def test_bpe_queries(spark, docs, texts, empty, bpe_file, library):
    encoded = bpe.encode(docs, bpe_file)
    assert encoded.columns == [*docs.columns, "__ids"]
    assert bpe.decode(encoded, bpe_file).where("__decoded <> coalesce(text, '')").count() == 0
    got = {r.doc_id: tuple(r)[1:] for r in bpe.round_trip(docs, bpe_file).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert got[k * 3] == (len(ids), sha(",".join(map(str, ids))), sha(t or ""))
    assert bpe.round_trip(empty, bpe_file).count() == 0


def test_code_lengths_are_optimal_and_limited():
    import heapq

    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 40, 200):
        counts = rng.integers(1, 10_000, n)
        heap = [(int(c), k, (k,)) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        depth = np.zeros(n, int)
        while len(heap) > 1:
            (a, _, x), (b, k, y) = heapq.heappop(heap), heapq.heappop(heap)
            depth[list(x + y)] += 1
            heapq.heappush(heap, (a + b, k, x + y))
        got = token_files.code_lengths(counts, 20)
        assert (got * counts).sum() == (np.maximum(depth, 1) * counts).sum()
    skewed = 2 ** np.arange(30)
    limited = token_files.code_lengths(skewed, 8)
    assert limited.max() <= 8 and (2.0 ** -limited).sum() <= 1
    assert token_files.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]


def test_codes_round_trip():
    rng = np.random.default_rng(6)
    for high in (1, 2, 300, 5000):
        counts = np.array([0, 1, 2, 255, 256, 257, 1000, 0])
        ids = np.minimum(rng.geometric(3 / high if high > 3 else 0.9, counts.sum()) - 1, high - 1).astype(np.uint32)
        code = token_files.Code(token_files.code_lengths(np.bincount(ids, minlength=high)))
        coded = code.encode(ids, counts)
        at = np.cumsum([0] + [len(b) for b, _ in coded])
        marks = np.concatenate([np.frombuffer(c, "<u8") + np.uint64(8 * a) for (_, c), a in zip(coded, at, strict=False)])
        assert code.decode(b"".join(b for b, _ in coded), marks, counts).tolist() == ids.tolist()


def test_token_files(spark, docs, texts, empty, bpe_file, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "PART_TOKENS", 20_000)
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 3_000)
    token_files.write(docs, bpe_file, f"{tmp_path}/a", end=2)
    start, got = 0, {r.doc_id: r for r in token_files.read(spark, f"{tmp_path}/a").collect()}
    crc = {r.doc_id: r.ids_crc32 for r in token_files.read(spark, f"{tmp_path}/a", digest=True).collect()}
    for k, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        r = got[k * 3]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        assert crc[k * 3] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    token_files.write(empty, bpe_file, f"{tmp_path}/b", end=2)
    assert token_files.read(spark, f"{tmp_path}/b").count() == 0
    rows = spark.createDataFrame([(None, None), (5, "x"), (5, "x"), (None, "y")], "doc_id long, text string")
    token_files.write(rows, bpe_file, f"{tmp_path}/c", end=2)
    back = token_files.read(spark, f"{tmp_path}/c").orderBy("start").collect()
    assert [r.doc_id for r in back] == [None, None, 5, 5] and [r.start for r in back][0] == 0


CHATS = [
    (1, 0, "system", "Be kind.\n"), (1, 1, "user", " hi <|im_end|>"), (1, 2, "assistant", "a\\<|im_start|>\\"), (1, 3, "assistant", "漢字🙂 x"),
    (2, 0, "user", None), (2, 1, None, "who"), (2, 2, "assistant", ""), (3, 1, "assistant", "<"), (3, 0, "user<|im_sep|>", "|"),
    (4, 0, "assistant", "<|endoftext|> <\\|im_sep|>"), (4, 0, "assistant", "<|endoftext|> <\\|im_sep|>"), (None, 0, "assistant", "  \n"), (5, 0, "assistant", "long " * 9000),
]


def test_chat_comes_back(spark, bpe_file):
    turns = spark.createDataFrame([(*r, "z") for r in CHATS], "conv_id long, turn long, role string, text string, ids string").repartition(4)
    made = chat.format_conversations(turns, bpe_file).cache()
    got = {r.conv_id: tuple(r)[1:] for r in chat.digests(made).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for conv in {c[0] for c in CHATS}:
        own = sorted(((t, r or "", x or "") for c, t, r, x in CHATS if c == conv), key=lambda v: v)
        loss = "".join(x for _, r, x in own if r == "assistant")
        text = chat.render([(r, x) for _, r, x in own], "assistant")[0]
        assert chat.parse(text) == [(r, x) for _, r, x in own]
        assert got[conv] == (len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)), len(loss), sha(loss), len(text))
    assert chat.format_conversations(turns.limit(0), bpe_file).count() == 0
    flagged = made.where(F.exists(F.arrays_zip("starts", "loss"), lambda z: z["loss"] & (z["starts"] == 0)))
    assert flagged.count() == 0


def test_mask_equals_overlaps():
    rng = random.Random(8)
    for _ in range(200):
        cuts = sorted(rng.sample(range(1, 60), 12))
        starts, ends = np.array([0, *cuts]), np.array([*cuts, 60])
        edge = sorted(rng.sample(range(61), 6))
        spans = [(edge[0], edge[1]), (edge[2], edge[3]), (edge[4], edge[5])] + [(edge[5], edge[5])]
        want = [any(a < e and s < b for a, b in spans) for s, e in zip(starts, ends, strict=True)]
        assert chat.loss_mask(starts, ends, spans).tolist() == want
