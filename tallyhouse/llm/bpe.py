"""BPE encoding and decoding with forced-boundary splitting.

A pair of neighbouring characters that lies inside no token of the vocabulary can't be crossed by any merge,
so it marks a certain cut. A text is cut at white space, then by the pre-tokenizer's pattern, then at
those pairs; the fragments are encoded one by one and their ids joined. That gives the ids of the undivided text,
bounds the work on very long words and makes fragments short enough to be worth remembering.

The vocabulary file is read on the driver, by a path that is a parameter, and broadcast: a
fixed file of a few MB. Workers remember the words they saw last, up to a fixed number.

Covers tokenizer files of the kind: NFC, white space, lower case; words by pattern; bytes as
characters; merges with an end-of-word suffix; special tokens found in the raw text.

Defined cases: a null text is empty and has no ids; decoding joins the tokens' strings with one blank, as a
file without decoder asks for; a symbol outside the vocabulary becomes the file's unknown token, if it names one, else nothing, as the library does;
a column that has the name of a result gives way; rows, ties and other columns don't affect each other.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._shared import bounded_batches

#: Unicode's White_Space. Fixed values.
_WHITE = "\t-\r \x85\xa0  -     　"
#: Words of which a worker remembers the ids.
REMEMBERED = 1_000_000
#: Up to so many symbols a list is searched instead of a heap.
SHORT = 40


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable bytes themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


class Encoder:
    """Encodes and decodes by a tokenizer file's content."""

    def __init__(self, content: str, remembered: int = REMEMBERED):
        spec = json.loads(content)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {m: i for i, m in reversed(list(enumerate(merges)))}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get(flag) for t in spec.get("added_tokens", []) for flag in ("single_word", "lstrip", "rstrip")) or any(t.get("normalized") for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens with single_word, lstrip, rstrip or normalized are not covered")
        unknown = model.get("unk_token")
        self.unknown: int | None = self.vocab.get(unknown) if unknown else None
        split = next((p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.white = regex.compile(f"[{_WHITE}]+")
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.bytes = byte_characters()
        self.texts = {i: t for t, i in (self.vocab | self.special).items()}
        self.inside = self._pairs_inside()
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.pieces: dict[str, list[int]] = {}
        self.remembered = remembered

    def _pairs_inside(self) -> set[str]:
        """Pairs of characters that lie side by side in some token, its end-of-word suffix aside."""
        pairs = set()
        for token in self.vocab:
            body = token.removesuffix(self.suffix) if self.suffix else token
            pairs.update(body[i : i + 2] for i in range(len(body) - 1))
        return pairs

    def fragments(self, piece: str) -> list[str]:
        """piece cut wherever a pair lies inside no token."""
        cuts = [0, *[i + 1 for i in range(len(piece) - 1) if piece[i : i + 2] not in self.inside], len(piece)]
        return [piece[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def merge_short(self, symbols: list[str]) -> list[str]:
        """The same for few symbols."""
        get, none = self.ranks.get, math.inf
        ranks = [get(p, none) for p in zip(symbols, symbols[1:], strict=False)]
        while ranks and (least := min(ranks)) != none:
            i = ranks.index(least)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = get((symbols[i], symbols[i + 1]), none)
        return symbols

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge the pair of the lowest rank, leftmost first, until none is left."""
        if len(symbols) <= SHORT:
            return self.merge_short(symbols)
        after, before, ranks = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)], self.ranks
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(len(symbols) - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        alive: list[str | None] = list(symbols)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if alive[i] != left or j < 0 or alive[j] != right:
                continue
            alive[i], alive[j] = left + right, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := ranks.get((alive[a], alive[b]))) is not None:
                    heapq.heappush(heap, (r, a, alive[a], alive[b]))
        return [s for s in alive if s is not None]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one match of the pattern."""
        known = self.pieces.get(piece)
        if known is not None:
            return known
        characters = "".join(map(self.bytes.__getitem__, piece.encode()))
        parts, ids = self.fragments(characters), []
        for k, part in enumerate(parts):
            symbols = list(part)
            if k == len(parts) - 1:
                symbols[-1] += self.suffix
            ids += [i for s in self.merge(symbols) if (i := self.vocab.get(s, self.unknown)) is not None]
        if len(piece) <= 64:
            if len(self.pieces) >= self.remembered // 4:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def encode_word(self, word: str) -> tuple[bytes, bytes]:
        """Ids of a run without white space, packed, and their tokens' strings, each followed by a blank."""
        # lower case is taken character by character, so a final sigma is no special case
        low = word.lower() if "Σ" not in word else "".join(c.lower() for c in word)
        ids = [i for piece in self.pattern.findall(low) for i in self.encode_piece(piece)]
        return struct.pack(f"<{len(ids)}I", *ids), self.decode_packed(ids)

    def decode_packed(self, ids: list[int]) -> bytes:
        return (" ".join(map(self.texts.__getitem__, ids)) + " ").encode() if ids else b""

    def remember(self, word: str) -> tuple[bytes, bytes]:
        found = self.older.get(word) or self.encode_word(word)
        if len(word) <= 64:
            if len(self.words) >= self.remembered // 2:
                self.older, self.words = self.words, {}
            self.words[word] = found
        return found

    def encode_plain(self, text: str) -> Iterator[tuple[bytes, bytes]]:
        words = self.words
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        for w in self.white.split(text):
            if w:
                yield words.get(w) or self.remember(w)
                words = self.words

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Packed ids and decoded text in UTF-8."""
        found: list[tuple[bytes, bytes]] = []
        at = 0
        for m in self.specials.finditer(text) if self.specials else ():
            found += self.encode_plain(text[at : m.start()])
            i = self.special[m[0]]
            found.append((struct.pack("<I", i), self.decode_packed([i])))
            at = m.end()
        found += self.encode_plain(text[at:] if at else text)
        return b"".join(a for a, _ in found), b"".join(b for _, b in found)[:-1]


@cache
def _encoder(content: str) -> Encoder:
    return Encoder(content)


def encode(docs: DataFrame, path: str, text: str = "text", digest: bool = False) -> DataFrame:
    """docs without the text, with ids (array of int) and decoded (string).

    digest: n_tokens, ids_sha256 and decoded_sha256 instead; both come from the ids and the decoded text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(path, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())
    new = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] if digest else [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())]
    docs = docs.drop(*[n for n, _ in new if n != text])
    at = docs.columns.index(text)
    schema = T.StructType([*[f for i, f in enumerate(docs.schema.fields) if i != at], *[T.StructField(n, t) for n, t in new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value)
        for b in batches:
            rows = [encoder.encode(x or "") for x in b.column(at).to_pylist()]
            if digest:
                made = [pa.array([len(i) // 4 for i, _ in rows], pa.int64()), *[pa.array([hashlib.sha256(r[k]).hexdigest() for r in rows], pa.string()) for k in (0, 1)]]
            else:
                made = [pa.array([list(struct.unpack(f"<{len(i) // 4}I", i)) for i, _ in rows], pa.list_(pa.int32())), pa.array([d.decode() for _, d in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(b.columns) if i != at], *made], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)
