"""BPE encoding and decoding by forced-boundary splitting.

A pair of neighbouring symbols that occurs inside no vocabulary token can never
be merged over, so it is a certain cut. A word falls apart at its certain cuts;
the fragments are merged on their own and their ids put together. Fragments and
words repeat, so their ids are kept in bounded tables.

The vocabulary file is one of the ``tokenizers`` library with word ends (BPE,
byte-level alphabet, ``end_of_word_suffix``). Results equal the library's
``encode(text, add_special_tokens=False)`` with truncation and padding off, and
``decode(ids, skip_special_tokens=False)``.

Nulls count as empty texts; an empty text has no tokens and decodes to "".
"""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import clean, give_back

#: Runs of characters remembered by one worker (twice as many for a while).
REMEMBERED = 1 << 16
NO_MERGE = 1 << 24
#: Symbols from which a fragment is merged by itself.
LONG = 128
#: Above this code point, case and character classes are left to the library.
PLAIN_UP_TO = "ԯ"
#: Space to Python, but not to the vocabulary's patterns.
ODD_SPACE = re.compile("[\x1c-\x1f]").search


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in own}
    letters |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in letters)}
    return letters


class Piece(NamedTuple):
    """What a run of non-space characters becomes: its ids, as text, and its tokens' names, each joined by a space."""

    digits: str
    names: str


class ForcedBoundaryBPE:
    def __init__(self, spec: str):
        made = json.loads(spec)
        model = made["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in made.get("added_tokens", [])}
        self.names = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = token
        self.digits = [str(i) for i in range(len(self.names))]
        letters = _byte_letters()
        self.byte_of = {c: b for b, c in letters.items()}
        #: symbols are numbered 0-255 inside a word and 256-511 at its end
        self.symbol_id = np.array([vocab[letters[b]] for b in range(256)] + [vocab[letters[b] + self.suffix] for b in range(256)], np.int64)
        #: side by side inside some vocabulary token, by symbol numbers
        self.joined = np.zeros((512, 512), bool)
        for token in vocab:
            ended = bool(self.suffix) and token.endswith(self.suffix) and token != self.suffix
            symbols = [self.byte_of[c] for c in (token.removesuffix(self.suffix) if ended else token)]
            symbols[-1] += 256 * ended
            self.joined[symbols[:-1], symbols[1:]] = True
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[x] << 32 | vocab[y] for x, y in pairs], np.int64)
        order = np.argsort(keys)
        self.pair, self.rank = keys[order], order.astype(np.int64)
        self.both = np.array([vocab[x + y] for x, y in pairs], np.int64)
        split = next(p for p in made["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self.spec, self._library = spec, None
        self.runs: dict[str, Piece] = {}
        self.older: dict[str, Piece] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], NO_MERGE)

    @functools.cached_property
    def merges(self) -> dict[int, tuple[int, int]]:
        """Pair of ids, packed, to its rank and the id of the two together; for long fragments."""
        return {k: (r, int(self.both[r])) for k, r in zip(self.pair.tolist(), self.rank.tolist())}

    def words(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Ids of all pre-tokens, put together, and where each one's ids end.

        Cut wherever a pair is in no token; merge each fragment; concatenate.
        """
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(r) for r in raw])
        symbols = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        symbols[ends - 1] += 256
        cut = np.ones(len(symbols), bool)
        cut[1:] = ~self.joined[symbols[:-1], symbols[1:]]
        cut[ends[:-1]] = True
        ids, kept = self.fragments(self.symbol_id[symbols], np.flatnonzero(cut))
        return ids.tolist(), np.cumsum(np.bincount(np.searchsorted(ends, kept, "right"), minlength=len(raw))).tolist()

    def fragments(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In every fragment (from ``first`` on) the pair of lowest rank, leftmost first, is merged until none is left.

        Each round merges one pair in each fragment that still has one. Returns
        the ids left and the places where they began.
        """
        n = len(ids)
        place = np.arange(n)
        part = np.zeros(n, np.int64)
        part[first[1:]] = 1
        part = np.cumsum(part)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        size = np.diff(np.r_[first, n])
        for i in np.flatnonzero(size > LONG):
            a, b = first[i], first[i] + size[i]
            kept, left = merge_long(ids[a:b].tolist(), self.merges)
            done.append((np.array(kept) + a, np.array(left)))
        short = np.repeat(size <= LONG, size)
        place, ids, part = place[short], ids[short], part[short]
        n = len(ids)
        rank = np.full(n, NO_MERGE)
        if n > 1:
            rank[:-1] = np.where(part[:-1] == part[1:], self.ranks(ids[:-1], ids[1:]), NO_MERGE)
        while n:
            begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            best = np.minimum.reduceat(rank * n + np.arange(n), begin)
            open_ = best < NO_MERGE * n
            if not open_.all():
                size = np.diff(np.r_[begin, n])
                stays = np.repeat(open_, size)
                done.append((place[~stays], ids[~stays]))
                place, ids, part, rank = place[stays], ids[stays], part[stays], rank[stays]
                best, n_old, n = best[open_], n, len(ids)
                if not n:
                    break
                at = np.cumsum(stays)[best % n_old] - 1
            else:
                at = best % n
            ids[at] = self.both[rank[at]]
            keep = np.ones(n, bool)
            keep[at + 1] = False
            # the merged symbol pairs anew with what stands after and before it
            after = np.minimum(at + 2, n - 1)
            ok = (at + 2 < n) & (part[after] == part[at])
            rank[at] = np.where(ok, self.ranks(ids[at], ids[after]), NO_MERGE)
            before = np.maximum(at - 1, 0)
            ok = (at > 0) & (part[before] == part[at])
            rank[before[ok]] = self.ranks(ids[before[ok]], ids[at[ok]])
            place, ids, part, rank = place[keep], ids[keep], part[keep], rank[keep]
            n = len(ids)
        place, ids = (np.concatenate(x) for x in zip(*done)) if done else (place, ids)
        order = np.argsort(place, kind="stable")
        return ids[order], place[order]

    def learn(self, runs: list[str]) -> None:
        """Pieces of runs that aren't remembered, all at once."""
        found = [self.find(r.lower() if r.isascii() else unicodedata.normalize("NFC", r).lower()) for r in runs]
        ids, ends = self.words([w for f in found for w in f])
        names, digits = self.names, self.digits
        at = a = 0
        if len(self.runs) + len(runs) > REMEMBERED:
            self.older, self.runs = self.runs, {}
        for run, f in zip(runs, found):
            at += len(f)
            b = ends[at - 1] if f else a
            self.runs[run] = Piece(" ".join([digits[i] for i in ids[a:b]]), " ".join([names[i] for i in ids[a:b]]))
            a = b

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.spec)
        return self._library

    def _odd(self, text: str) -> list[Piece]:
        """A text with characters whose case or class may differ between Unicode versions: the library cuts it into words."""
        normal = self.library.normalizer.normalize_str(text)
        words = [bytes([self.byte_of[c] for c in w]).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        if not words:
            return []
        ids, _ = self.words(words)
        return [Piece(" ".join([self.digits[i] for i in ids]), " ".join([self.names[i] for i in ids]))]

    def pieces(self, texts: list[str]) -> list[list[Piece]]:
        """Pieces of each text. No pre-token holds a space, so other runs of characters stand alone."""
        parts: list[list[str | Piece]] = []
        plain: list[list[str]] = []
        for text in texts:
            mine: list[str | Piece] = []
            for part in self.cut_special(text) if any(s in text for s in self.special) else [text]:
                if part in self.special:
                    mine.append(Piece(self.digits[self.special[part]], part))
                elif ODD_SPACE(part) or not part.isascii() and (max(part) > PLAIN_UP_TO or "Σ" in part):
                    mine += self._odd(part)
                else:
                    mine += part.split()
            parts.append(mine)
            plain.append([x for x in mine if x.__class__ is str])
        wanted = set().union(*plain)
        known = {r: p for r in wanted if (p := self.runs.get(r) or self.older.get(r)) is not None}
        wanted.difference_update(known)
        if wanted:
            self.learn(new := list(wanted))
            known.update((r, self.runs[r]) for r in new)
        for r, p in known.items():
            if len(self.runs) < REMEMBERED and len(r) <= 64:
                self.runs[r] = p
        return [[known[x] if x.__class__ is str else x for x in mine] for mine in parts]

    def encode(self, text: str) -> list[int]:
        return [int(i) for piece in self.pieces([text])[0] for i in piece.digits.split()]

    def decode(self, ids: list[int]) -> str:
        """No decoder is set in the vocabulary file, so token names stand side by side."""
        return " ".join([self.names[i] for i in ids if 0 <= i < len(self.names)])


def merge_long(ids: list[int], merges: dict[int, tuple[int, int]]) -> tuple[list[int], list[int]]:
    """The same merges by a heap: n log n for a long fragment. Places where the ids left began, and those ids."""
    n = len(ids)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(*merges[p], i, p) for i in range(n - 1) if (p := ids[i] << 32 | ids[i + 1]) in merges]
    heapq.heapify(heap)
    while heap:
        _, both, i, pair = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j < 0 or ids[i] << 32 | ids[j] != pair:
            continue
        ids[i], ids[j] = both, -1
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (p := ids[a] << 32 | ids[b]) in merges:
                heapq.heappush(heap, (*merges[p], a, p))
    kept = [i for i in range(n) if ids[i] >= 0]
    return kept, [ids[i] for i in kept]


_made: dict[str, ForcedBoundaryBPE] = {}


def tokenizer(spec: str) -> ForcedBoundaryBPE:
    """One for each worker and vocabulary."""
    key = hashlib.sha1(spec.encode()).hexdigest()
    if key not in _made:
        _made[key] = ForcedBoundaryBPE(spec)
    return _made[key]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    with_ids: bool = True,
    with_text: bool = True,
    with_digests: bool = False,
) -> DataFrame:
    """Tokens of every whole text: doc_id, n_tokens, then as asked for ``ids``, ``decoded`` and the SHA-256 of both.

    ``vocabulary`` is the path of a vocabulary file on the driver. Its content,
    of fixed size, travels in one broadcast. Null texts count as empty and have no
    tokens; a very long text is cut at certain places only, so its tokens are those of
    the whole. Repeated rows each give a row, as do null ids; an empty table gives an
    empty result. Other columns are never looked at, whatever their names.
    """
    spark: SparkSession = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    names = ["ids"] * with_ids + ["decoded"] * with_text + ["ids_sha256", "decoded_sha256"] * with_digests
    types = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    arrow = {"ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = gc.isenabled()
        gc.disable()  # the remembered runs hold no cycles, and scanning them over and over is costly
        try:
            yield from encoded(batches)
        finally:  # the worker goes on with other tasks, and has other things to hold
            if on:
                gc.enable()
            _made.clear()
            give_back()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(spec.value)
        sha = hashlib.sha256
        for whole in batches:
            for a in range(0, max(1, whole.num_rows), 256):
                batch = whole.slice(a, 256)
                got: dict[str, list] = {k: [] for k in ("n", *names)}
                for pieces in bpe.pieces(batch.column(1).to_pylist()):
                    digits = " ".join([p[0] for p in pieces if p[0]])
                    got["n"].append(digits.count(" ") + 1 if digits else 0)
                    if with_ids:
                        got["ids"].append([int(i) for i in digits.split()])
                    # names of tokens are joined by one space, so the pieces' decoded forms are too
                    decoded = " ".join([p[1] for p in pieces if p[0]]) if with_text or with_digests else ""
                    if with_text:
                        got["decoded"].append(decoded)
                    if with_digests:
                        got["ids_sha256"].append(sha(digits.encode()).hexdigest())
                        got["decoded_sha256"].append(sha(decoded.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(got["n"], pa.int64()), *(pa.array(got[k], arrow[k]) for k in names)],
                    names=["doc_id", "n_tokens", *names],
                )

    schema = "doc_id long, n_tokens long" + "".join(f", {k} {types[k]}" for k in names)
    return clean(docs, id_col, text_col).mapInArrow(run, schema)


def decode_documents(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of token ids: doc_id, decoded; null ids decode to ""."""
    spec = tokens.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(spec.value)
        for batch in batches:
            out = [bpe.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "decoded"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col)).mapInArrow(run, "doc_id long, decoded string")
