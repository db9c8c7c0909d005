"""Byte-level BPE encoding and decoding with forced-boundary splitting.

From the vocabulary we read which byte pairs never stand next to each other inside a token. No merge can cross such a
pair, so every occurrence is a certain cut. Texts are cut first at pairs whose right byte is ASCII white space, or whose
left one is an ASCII letter and right one a mark, where the cut also cannot change how the word pattern splits either
side: it ends a run of letters there, and begins anew without a look behind. Each distinct piece is then split by the pattern,
cut again at every forced pair, and its fragments are merged independently. The ids of a text are the concatenation.
Fragments are merged by tiktoken's merge of one piece over this vocabulary's ranks, if every token is what its own bytes
merge to, which is tried when the vocabulary is loaded; or else by the merge list, pair by pair.
Short pieces and fragments are remembered in tables of TABLE_BYTES, which only save time.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import columns_but, fresh

#: How this family of vocabularies splits a text before merging: a fixed value of the tokenizer format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_ONE_WORD, _LINE_AND_WORD = re.compile(rb" ?[A-Za-z]+").fullmatch, re.compile(rb"\n[A-Za-z]+").fullmatch
#: Bytes of a table of pieces or of fragments in a worker, what an entry takes beside its strings, and the longest key
#: that is remembered. A full table is kept as the last while a new one fills, so a worker holds four times TABLE_BYTES.
TABLE_BYTES, ENTRY_BYTES, LONGEST_KEY = 16 * 2**20, 280, 64


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, as its format defines."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Remembered(dict):
    """What make() gives for short keys, in a table of TABLE_BYTES beside the one before it; longer keys are made each time."""

    def __init__(self, make):
        super().__init__()
        self.make, self.last, self.room = make, {}, TABLE_BYTES

    def __missing__(self, key):
        if len(key) > LONGEST_KEY:
            return self.make(key)
        found = self.last.get(key)
        found = self.make(key) if found is None else found
        self.room -= ENTRY_BYTES + len(key) + len(found[0]) + len(found[1])
        if self.room < 0:
            self.last, self.room = dict(self), TABLE_BYTES
            self.clear()
        self[key] = found
        return found


class Bpe:
    """Encoder and decoder of one vocabulary file's text."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        byte_of = byte_symbols()
        raw = lambda token: bytes(byte_of[c] for c in token)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in byte_of for c in t)}
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        for text in self.special:
            vocab.pop(text, None)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pairs = [(raw(a), raw(b)) for a, b in merges]
        self.rank = {p: r for r, p in reversed(list(enumerate(pairs)))}
        order = [bytes([i]) for i in range(256)] + [a + b for a, b in pairs]
        self.id_of, self.id_of_rank = vocab, [vocab[t] for t in order]
        # a merge's rank is its place; where every token is what its own bytes merge to, ranks of tokens suffice
        self.by_ranks, self.merger, self.ids_of_ranks = None, None, np.array(self.id_of_rank, "<u4")
        if len(set(order)) == len(order):
            merger = tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks={t: r for r, t in enumerate(order)}, special_tokens={})
            one = getattr(merger, "_encode_single_piece", None)
            if one is not None and all(one(t) == [r] for r, t in enumerate(order)) and all(self.merged(a + b) == [a + b] for a, b in pairs):
                self.by_ranks, self.merger = one, merger
        self.bytes_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.coded_rank = [self._packed([i]) for i in self.id_of_rank]
        inside = {(t[i], t[i + 1]) for t in vocab for i in range(len(t) - 1)}
        self.forced = {(x, y) for x in range(256) for y in range(256)} - inside
        # white space before which a cut is forced after all but a few bytes; those few are never cut there
        few = {y: {x for x in range(256) if x not in b" \t\n\r" and (x, y) not in self.forced} for y in b" \t\n\r"}
        space = sorted(y for y, x in few.items() if len(x) <= 16)
        blank, uncut = (b"".join(b"\\x%02x" % x for x in sorted(c)) for c in (space, set().union(*(few[y] for y in space))))
        joined = b"(?:(?<=[%b])[%b]+[^%b]*)*" % (uncut, blank, blank) if uncut else b""
        marks = [x for x in b",.;:!?)" if all((y, x) in self.forced for y in LETTERS)]
        before = b"[%b]*[A-Za-z]++(?=[%b])|" % (blank, b"".join(b"\\x%02x" % x for x in marks)) if marks else b""
        self.split_text = re.compile(b"%b[%b]*[^%b]+%b|[%b]+" % (before, blank, blank, joined, blank)).findall if space else (lambda t: [t] if t else [])
        self.split_special = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + b")").split if self.special else None
        self.split_piece = regex.compile(PATTERN).findall
        self.pieces, self.fragments = Remembered(self._piece), Remembered(self._fragment)

    def merged(self, fragment: bytes) -> list[bytes]:
        """The tokens of a fragment by the merge list: the pair of least rank is merged, its first place first."""
        parts = [fragment[i : i + 1] for i in range(len(fragment))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), len(self.rank)))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _packed(self, ids: list[int]) -> tuple[bytes, bytes]:
        """(ids as little-endian 32-bit integers, the bytes that they decode to)."""
        return struct.pack(f"<{len(ids)}I", *ids), b"".join([self.bytes_of.get(i, b"") for i in ids])

    def _fragment(self, fragment: bytes) -> tuple[bytes, bytes]:
        if self.by_ranks is not None:
            coded = [self.coded_rank[r] for r in self.by_ranks(fragment)]
            return coded[0] if len(coded) == 1 else (b"".join([c[0] for c in coded]), b"".join([c[1] for c in coded]))
        return self._packed([self.id_of[t] for t in self.merged(fragment)])

    def _piece(self, piece: bytes) -> tuple[bytes, bytes]:
        forced, found = self.forced, []
        # one word for the pattern, as most pieces are
        one = _ONE_WORD(piece)
        if one and forced.isdisjoint(zip(piece, piece[1:], strict=False)):
            return self._fragment(piece)  # the table of pieces remembers it
        if _LINE_AND_WORD(piece):  # two words for the pattern
            found = [self.pieces[piece[:1]], self.pieces[piece[1:]]]
            return found[0][0] + found[1][0], found[0][1] + found[1][1]
        for data in [piece] if one else [w.encode() for w in self.split_piece(piece.decode())]:
            if forced.isdisjoint(zip(data, data[1:], strict=False)):
                found.append(self.fragments[data])
                continue
            lo = 0
            for i, pair in enumerate(zip(data, data[1:], strict=False), 1):
                if pair in forced:
                    found.append(self.fragments[data[lo:i]])
                    lo = i
            found.append(self.fragments[data[lo:]])
        return found[0] if len(found) == 1 else (b"".join([f[0] for f in found]), b"".join([f[1] for f in found]))

    def pieces_of(self, text: bytes) -> tuple[bytes, bytes]:
        """(ids as little-endian 32-bit integers, the bytes that they decode to) of a whole text in UTF-8."""
        if self.split_special is None or not any(t in text for t in self.special):
            parts = [self.pieces[x] for x in self.split_text(text)]
        else:
            parts = []
            for i, part in enumerate(self.split_special(text)):
                parts += [self._packed([self.special[part]])] if i % 2 else [self.pieces[x] for x in self.split_text(part)]
        return b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])

    def packed_ids(self, text: bytes) -> bytes:
        """The ids of a whole text in UTF-8, as little-endian 32-bit integers."""
        if self.split_special is None or not any(t in text for t in self.special):
            pieces = self.pieces
            return b"".join([pieces[x][0] for x in self.split_text(text)])
        return self.pieces_of(text)[0]

    def unsplit_ids(self, text: str) -> bytes:
        """packed_ids() by the merging library over whole texts, without forced cuts, where its merges are exact."""
        if self.merger is None or any(t.decode() in text for t in self.special):
            return self.packed_ids(text.encode())
        return self.ids_of_ranks[self.merger.encode_ordinary(text)].tobytes() if text else b""

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.pieces_of(text.encode())[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; unknown ids are left out, and bytes that are no UTF-8 become U+FFFD."""
        return b"".join([self.bytes_of.get(i, b"") for i in ids]).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def loaded(vocabulary: str) -> Bpe:
    """The encoder of a vocabulary file's text, kept for the life of a worker."""
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(vocabulary)
    return _loaded[key]


def _lists(packed: list[bytes]) -> pa.Array:
    """An array of lists of 32-bit integers from their bytes."""
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))


#: What bpe_columns can make of a text: name -> (Spark type, function of the packed ids and the bytes they decode to, array).
OUTPUTS = {
    "ids": ("array<int>", lambda ids, data: ids, _lists),
    "decoded": ("string", lambda ids, data: data.decode("utf-8", "replace"), lambda x: pa.array(x, pa.string())),
    "n_tokens": ("bigint", lambda ids, data: len(ids) // 4, lambda x: pa.array(x, pa.int64())),
    "ids_sha256": ("string", lambda ids, data: hashlib.sha256(ids).hexdigest(), lambda x: pa.array(x, pa.string())),
    "decoded_sha256": ("string", lambda ids, data: hashlib.sha256(data.decode("utf-8", "replace").encode()).hexdigest(), lambda x: pa.array(x, pa.string())),
}


def bpe_columns(docs: DataFrame, vocabulary_path: str, outputs: tuple[str, ...] = ("ids",), text: str = "text") -> DataFrame:
    """docs with the asked OUTPUTS of its text column as columns; columns of these names, in any case, are replaced.

    The vocabulary file (a few MB at most) is read on the driver and broadcast. Null text counts as empty: no ids,
    decoded to an empty text. Special tokens written in a text are read as such, and decoding keeps them. Texts are
    encoded whole: a very long one costs its task memory in proportion. Repeated rows give repeated results; an empty
    table gives an empty table.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kinds = ", ".join(f"{o}: {OUTPUTS[o][0]}" for o in outputs)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(shared.value)
        for texts in batches:
            made: dict[str, list] = {o: [] for o in outputs}
            for t in texts:  # texts stay in Arrow's memory; one at a time is taken out
                data = t.as_buffer()
                coded = bpe.pieces_of(b"" if data is None else data.to_pybytes())
                for o in outputs:
                    made[o].append(OUTPUTS[o][1](*coded))
            yield pa.StructArray.from_arrays([OUTPUTS[o][2](made[o]) for o in outputs], names=list(outputs))

    coded = fresh(docs, "bpe")
    out = docs.withColumn(coded, F.arrow_udf(run, returnType=f"struct<{kinds}>")(F.col(text)))
    return out.select(*columns_but(docs, *outputs), *[F.col(f"{coded}.{o}") for o in outputs])


def digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): one row a document, as bpe_columns() encodes its whole text.

    Null text counts as empty; repeated rows and null ids stay; other columns are ignored; an empty table gives an empty table.
    """
    return bpe_columns(docs.select("doc_id", "text"), vocabulary_path, ("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")
