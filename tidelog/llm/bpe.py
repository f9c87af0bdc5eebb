"""Byte-level BPE by batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round looks up the ranks of all neighbouring pairs by binary
search over the sorted pair keys, takes the lowest rank of every word, and merges all its occurrences at once; words
without a known pair leave the array. A worker keeps the ids of words that it has met lately (twice YOUNG and two batches).
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Pieces after which a Python worker's young cache becomes the old one. Pieces of the old one that are met again move
#: to the young one; the rest are forgotten with the next change.
YOUNG = 20_000
#: Rows and bytes of texts encoded together at most (one longer text is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 2_000, 2_500_000
NONE = np.int64(1 << 40)
#: Pieces of a text at whose borders the pre-tokenizer always splits: letters, other runs, white space.
PIECES = re.compile(r" ?[^\W\d_]+(?!\w)| ?\S+|\s+(?!\S)|\s+")
#: Texts that are cut by pattern (RE2): other white space than single blanks and line ends inside, or the mark; stops
#: and commas that follow anything but letters and digits.
UNEVEN = (
    r"^[ \n]|[ \n]\z|  |\n\n| \n|\n |[\t\r\f\v\x01\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    r"|[^\pL\pN][.,]|^[.,]"
)
#: White space to Python's patterns but not to Unicode's property.
ODD = re.compile("[\x1c-\x1f]")
#: Pieces that are one word to the pre-tokenizer without a closer look.
PLAIN = re.compile(" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[.,])")
#: The pre-tokenizer's pattern of this family of vocabularies (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself where visible, else from U+0100 on."""
    visible = {b for lo, hi in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(lo, hi + 1)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[start : start + length] of the entries at, one after another, and where each of them ends."""
    n = length[at]
    ends = np.cumsum(n, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    source = np.repeat((start[at] - (ends - n)).astype(kind), n)
    source += np.arange(total, dtype=kind)
    return flat[source], ends


def table_of(entries: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """flat, start, length of byte strings, for gather()."""
    size = np.dtype(kind).itemsize
    length = np.fromiter(map(len, entries), np.int64, len(entries)) // size
    return np.frombuffer(b"".join(entries), kind), np.cumsum(length) - length, length


class PieceCoder:
    """Encodes whole texts from the ids of their distinct pieces; learn() gives those of pieces that are new."""

    added: dict[str, int]
    young = YOUNG

    def __init__(self):
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.special = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.uneven = UNEVEN + "".join("|" + re.sub(r"([^\w])", r"\\\1", x) for x in self.added)

    def learn(self, pieces: list[str]) -> list[bytes]:
        raise NotImplementedError

    def cut(self, text: str) -> list[str]:
        """The pieces of any text, by pattern."""
        raise NotImplementedError

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        if len(self.known) > self.young:
            self.older, self.known = self.known, {}
        got = list(map(self.known.get, pieces))
        missed = [p for p, x in zip(pieces, got) if x is None]
        if missed:
            fresh = dict(zip(missed, map(self.older.get, missed)))
            new = [p for p, x in fresh.items() if x is None]
            fresh.update(zip(new, self.learn(new)))
            got = [fresh[p] if x is None else x for p, x in zip(pieces, got)]
            self.known.update(fresh)
        return got

    def odd_text(self, text: str) -> np.ndarray:
        out = []
        for s in self.special.split(text) if self.special else [text]:
            out += [self.added[s].to_bytes(4, "little")] if s in self.added else self.ids_of(self.cut(s)) if s else []
        return np.frombuffer(b"".join(out), "<u4")

    def encode_batch(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text (null: none), as little-endian unsigned 32-bit integers.

        White space of single blanks and line ends, and stops and commas after letters and digits, are where Arrow
        splits texts; the distinct pieces of the batch are looked up once each. Other texts are cut by pattern.
        """
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, self.uneven)
        marked = pc.if_else(odd, "", texts)
        for mark, to in ((" ", "\x01 "), ("\n", "\x01\n\x01"), (",", "\x01,"), (".", "\x01.")):
            marked = pc.replace_substring(marked, mark, to)
        split = pc.split_pattern(marked, "\x01")
        words = split.flatten().dictionary_encode()
        flat, start, length = table_of(self.ids_of(words.dictionary.to_pylist()), "<u4")
        ids, ends = gather(flat, start, length, words.indices.to_numpy())
        cut = np.concatenate(([0], ends))[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        out = [ids[i:j] for i, j in zip(cut, cut[1:])]
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[k] = self.odd_text(texts[k].as_py())
        return out


class Encoder(PieceCoder):
    """A byte-level BPE vocabulary of the tokenizers library, read from its JSON file."""

    def __init__(self, path: str):
        import regex


        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab, names = told["model"]["vocab"], byte_symbols()
        self.added = {x["content"]: x["id"] for x in told["added_tokens"]}
        if told["normalizer"] or told["pre_tokenizer"]["add_prefix_space"] or any(x[k] for x in told["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("only plain byte-level vocabularies are read")
        self.size = 1 + max([*vocab.values(), *self.added.values()])
        self.of_byte = np.array([vocab[c] for c in names], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        back = {c: b for b, c in enumerate(names)}
        self.bytes_of = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.words = regex.compile(WORDS)
        self.bytes_table = table_of(self.bytes_of, "u1")
        super().__init__()
        self.special = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        out = [b""] * len(words)
        flat = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        rank = np.full(len(flat), NONE)  # of each symbol and its right neighbour
        same = np.flatnonzero(owner[1:] == owner[:-1])
        rank[same] = self.pair_ranks(flat[same], flat[same + 1])
        while len(flat):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            length = np.diff(np.concatenate((first, [len(flat)])))
            least = np.minimum.reduceat(rank, first)
            ended = least == NONE
            ids = flat.astype("<u4").tobytes()
            for w, s, n in zip(owner[first[ended]].tolist(), first[ended].tolist(), length[ended].tolist()):
                out[w] = ids[4 * s : 4 * s + 4 * n]
            lowest = np.repeat(least, length)
            at = np.flatnonzero((rank == lowest) & (lowest != NONE))
            if len(at) > 1:  # of overlapping occurrences (a a a), every other one from the left
                fresh = np.concatenate(([True], np.diff(at) > 1))
                start = np.maximum.accumulate(np.where(fresh, at, 0))
                at = at[(at - start) % 2 == 0]
            flat[at] = self.merged[rank[at]]
            keep = np.repeat(~ended, length)
            keep[at + 1] = False
            touched = np.zeros(len(flat), bool)  # pairs to look up again: of a merged symbol and its neighbours
            touched[at] = True
            touched[at[at > 0] - 1] = True
            behind = at[(at > 1)]
            touched[behind[~keep[behind - 1]] - 2] = True
            flat, owner, rank, touched = flat[keep], owner[keep], rank[keep], np.flatnonzero(touched[keep])
            rank[touched] = NONE
            touched = touched[touched + 1 < len(flat)]
            touched = touched[owner[touched] == owner[touched + 1]]
            rank[touched] = self.pair_ranks(flat[touched], flat[touched + 1])
        return out

    def learn(self, pieces: list[str]) -> list[bytes]:
        split = [(p,) if PLAIN.fullmatch(p) else self.words.findall(p) for p in pieces]
        words = list({w for s in split for w in s})
        ids = dict(zip(words, self.merge([w.encode("utf-8", "replace") for w in words])))
        return [ids[s[0]] if len(s) == 1 else b"".join(map(ids.__getitem__, s)) for s in split]

    def cut(self, text: str) -> list[str]:
        return self.words.findall(text) if ODD.search(text) else PIECES.findall(text)

    def decode_batch(self, docs: list[np.ndarray]) -> list[bytes]:
        """The texts of ids in UTF-8, added tokens included; bytes that aren't UTF-8 become U+FFFD."""
        flat, ends = gather(*self.bytes_table, np.concatenate(docs) if docs else np.empty(0, np.uint32))
        stops = np.concatenate(([0], ends))[np.cumsum([0, *map(len, docs)])].tolist()
        raw = [flat[i:j].tobytes() for i, j in zip(stops, stops[1:])]
        return [x if x.isascii() else x.decode("utf-8", "replace").encode() for x in raw]


def per_worker(kind: type, path: str):
    """The object that this Python worker keeps for a file, over all its tasks."""
    kept = sys.modules.setdefault("_tidelog_kept", types.ModuleType("_tidelog_kept")).__dict__
    key = f"{kind.__name__}:{path}"
    if key not in kept:
        kept[key] = kind(path)
    return kept[key]


def text_batches(batch: pa.RecordBatch):
    """first row, texts of parts of a batch that are small enough to encode together."""
    texts = batch.column("text").cast(pa.large_string())
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        n = max(1, int(np.searchsorted(np.cumsum(size[at : at + BATCH_ROWS]), BATCH_BYTES, "right")))
        yield at, texts.slice(at, n)
        at += n
        pa.default_memory_pool().release_unused()


def encode_decode(docs: DataFrame, path: str, texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with texts also ids array<int> and decoded.

    The ids are those of the tokenizers library without added special tokens; a special token's string in a text
    becomes its id. Null and empty texts have no ids. Repeated rows and null ids come out as they went in; columns
    other than doc_id and text are not read. Empty input: empty result.
    """

    def run(batches):
        bpe = per_worker(Encoder, path)
        for batch in batches:
            for at, some in text_batches(batch):
                ids = bpe.encode_batch(some)
                back = bpe.decode_batch(ids)
                cols = [
                    batch.column("doc_id").slice(at, len(some)),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                ]
                if texts:
                    cols += [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([x.decode() for x in back], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts
    )
