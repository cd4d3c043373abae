"""Byte-level BPE by backtracking, and decoding by an offset table.

A sequence of tokens is the result of the merge rules exactly when each neighbouring pair is: no
merge across their border comes before the merges that built them. So a word is encoded without
running merges: an Aho-Corasick automaton over all tokens finds what starts at each place, the
longest token is tried first, the pair with its predecessor is checked in a table that is filled on
demand, and a dead end steps back; dead places are remembered, so the work is linear in the word.
Ids decode through one byte string of all tokens and a table of offsets, a whole block at a time.

Reads tokenizer files of the kind ``BPE`` with a byte-level pre-tokenizer and without normaliser.

Defined results: a null text is empty and has no ids; strings of added tokens inside a text become
those tokens, as the library does; repeated rows and extra columns stay; ids outside the vocabulary
cannot be decoded (an error). Very long words take memory in proportion to their length.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pactlane.llm.blocks import give_back, sheltered, text_blocks
from pactlane.llm.pieces import Memory

# Fixed value: the split pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


REMEMBERED = 120_000  # encoded pieces a worker keeps; more of them take memory (about 0.25 kB each) and save time


def byte_letters() -> dict[str, int]:
    """Letter -> byte of the byte-level alphabet: visible Latin-1 characters stand for themselves, the
    other bytes for the code points from 256 on, in order."""
    seen = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class Coder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE file")
        letters = byte_letters()
        latin = {name: "".join(chr(letters[c]) for c in name) for name in model["vocab"] if all(c in letters for c in name)}
        ids = model["vocab"]
        self.id_of = {word: ids[name] for name, word in latin.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *special.values()]) + 1
        texts: list[bytes] = [b""] * size
        for name, word in latin.items():
            texts[ids[name]] = word.encode("latin-1")
        for name, k in special.items():
            texts[k] = name.encode("utf-8")
            self.id_of.pop(latin.get(name), None)
        self.length = [len(t) for t in texts]
        self.blob = np.frombuffer(b"".join(texts), np.uint8)
        self.offset = np.concatenate(([0], np.cumsum(self.length)))
        self.special = special
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.words = regex.compile(PATTERN)
        # merge rules: rank of a pair, and the parts and rank of a merged token
        self.pair: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = ids[left], ids[right]
            whole = ids[left + right]
            if whole in self.parts:
                raise ValueError("two merges make the same token")
            self.pair[a, b] = rank
            self.parts[whole] = (a, b, rank)
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        # a word may only be cut into tokens that the merges can make
        self.id_of = {w: k for w, k in self.id_of.items() if (k in self.parts or len(w) == 1) and self.reachable(k)}
        self.machine = ahocorasick.Automaton()
        self.shorter = [-1] * size  # the longest token that is a proper prefix
        for word, k in self.id_of.items():
            self.machine.add_word(word, k)
            self.shorter[k] = next((self.id_of[word[:n]] for n in range(len(word) - 1, 0, -1) if word[:n] in self.id_of), -1)
        self.machine.make_automaton()
        self.known: dict[str, list[int]] = {}  # pre-tokens met lately
        self.memory = Memory(self.encode_pieces, remembered)
        del spec, model, letters, latin, ids, texts
        give_back()

    def _edge(self, token: int, side: int) -> Iterator[tuple[int, int]]:
        """Tokens at one edge of a token, from the token down to its last byte, each with the rank of
        the merge that swallowed it."""
        swallowed = 1 << 60
        while True:
            yield token, swallowed
            if token not in self.parts:
                return
            swallowed, token = self.parts[token][2], self.parts[token][side]

    def compatible(self, left: int, right: int) -> bool:
        """No merge across the border comes before the merges inside; of equal ranks the left one is first."""
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            ends = list(self._edge(right, 0))
            known = True
            for a, inner_a in self._edge(left, 1):
                for b, inner_b in ends:
                    rank = self.pair.get((a, b))
                    if rank is not None and rank < inner_a and rank <= inner_b:
                        known = False
            if len(self.fits) > 400_000:
                self.fits.clear()
            self.fits[key] = known
        return known

    def reachable(self, token: int) -> bool:
        """The merges make this token of its own bytes."""
        known = self.whole.get(token)
        if known is None:
            if token not in self.parts:
                known = True
            else:
                a, b, rank = self.parts[token]
                # its halves must come about, and nothing may cross their border before they are merged
                known = self.reachable(a) and self.reachable(b)
                ends = list(self._edge(b, 0))
                for x, inner_x in self._edge(a, 1):
                    for y, inner_y in ends:
                        r = self.pair.get((x, y))
                        if r is not None and r < rank and r < inner_x and r <= inner_y:
                            known = False
            self.whole[token] = known
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token, given as its bytes in Latin-1."""
        whole = self.id_of.get(word)
        if whole is not None:
            return [whole]
        n, length, shorter, fits = len(word), self.length, self.shorter, self.fits
        longest = [-1] * n
        for end, token in self.machine.iter(word):
            longest[end + 1 - length[token]] = token  # of the tokens that start there, the last one ends last
        dead: set[int] = set()
        at, out, last, token = 0, [], -1, longest[0]
        while True:
            while token >= 0:
                end = at + length[token]
                if end not in dead:
                    if last < 0:
                        break
                    fit = fits.get(last << 32 | token)
                    if self.compatible(last, token) if fit is None else fit:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                at, last, token = end, token, longest[end]
            else:
                dead.add(at)
                token = out.pop()
                at -= length[token]
                last, token = out[-1] if out else -1, shorter[token]

    def encode_pieces(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > 60_000:
            self.known.clear()
        whole = "\n".join(texts)
        special = any(s in whole for s in self.special)
        return [array("I", self._encode(t, special)).tobytes() for t in texts]

    def _encode(self, text: str, special: bool = True) -> list[int]:
        out: list[int] = []
        special = special and self.cut is not None
        for part in self.cut.split(text) if special else (text,):
            if special and part in self.special:
                out.append(self.special[part])
                continue
            for word in self.words.findall(part):
                ids = self.known.get(word)
                if ids is None:
                    ids = self.known[word] = self.encode_word(word if word.isascii() else word.encode("utf-8").decode("latin-1"))
                out += ids
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each."""
        return self.memory.ids(texts)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 text of each run of ids."""
        if len(ids) and int(ids.max()) >= len(self.length):
            raise ValueError("an id outside the vocabulary")
        start = self.offset[ids]
        size = self.offset[ids.astype(np.int64) + 1] - start
        stop = np.cumsum(size)
        data = self.blob[np.repeat(start - stop + size, size) + np.arange(int(stop[-1]) if len(stop) else 0)].tobytes()
        edge = np.concatenate(([0], stop))[np.concatenate(([0], np.cumsum(counts)))]
        return [data[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


_CODERS: dict[str, Coder] = {}


def coder(path: str, remembered: int) -> Coder:
    """One coder per file and worker."""
    if path not in _CODERS:
        _CODERS.clear()
        _CODERS[path] = Coder(path, remembered)
    return _CODERS[path]


def _encode(path: str, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, remembered)
        for batch, texts in text_blocks(batches):
            ids, counts = own.encode([(t or b"").decode("utf-8") for t in texts])
            edge = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            lists = pa.ListArray.from_arrays(edge, pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "__ids"])

    return run


@sheltered("doc_id", "text")
def encode(docs: DataFrame, path: str, remembered: int = REMEMBERED) -> DataFrame:
    """``docs`` with ``__ids``, the token ids of ``text``."""
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(_encode(path, remembered), ", ".join([*columns, "__ids array<int>"]))


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, REMEMBERED)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("__ids")).fill_null([])
            counts = np.diff(lists.offsets.to_numpy())
            text = own.decode(lists.flatten().to_numpy().view(np.uint32), counts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.binary()).cast(pa.string())], names=[*batch.schema.names, "__decoded"])

    return run


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ``__decoded``, the text of ``__ids`` (array of int; null: empty)."""
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    return rows.mapInArrow(_decode(path), ", ".join([*columns, "__decoded string"]))


def _round_trip(path: str, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, remembered)
        decimal = [str(k) for k in range(len(own.length))]
        for batch, texts in text_blocks(batches):
            ids, counts = own.encode([(t or b"").decode("utf-8") for t in texts])
            names, at, hashes = ids.tolist(), 0, []
            for n in counts.tolist():
                hashes.append(hashlib.sha256(",".join(map(decimal.__getitem__, names[at : at + n])).encode()).hexdigest())
                at += n
            back = [hashlib.sha256(t).hexdigest() for t in own.decode(ids, counts)]
            out = [batch.column(batch.schema.get_field_index("doc_id")), pa.array(counts), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(docs: DataFrame, path: str, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, number of ids, and digests of the ids and of the text decoded from them."""
    return docs.select("doc_id", "text").mapInArrow(_round_trip(path, remembered), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
