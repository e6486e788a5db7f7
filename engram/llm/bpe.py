"""Byte-level BPE encoding and decoding by longest matches and backtracking.

Bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton over the vocabulary finds every token that
occurs in a piece. From the left, the longest token that may follow the previous one is taken; where none leads to the
end, the walk steps back. A pair of tokens may stand side by side if merging their joined bytes gives that pair again;
this is memoised. A sequence whose neighbours are all compatible is the one that the merges make, so the result is
exact, and each position is given up at most once, so the time is linear in the piece.

Cases: null text counts as empty; an empty text has no tokens; text of any length is encoded whole; bytes that are not
UTF-8 count as the replacement character.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm._common import map_batches, valid

#: Segments, and pairs of tokens, remembered by a Python worker; a memo is emptied when it is full, and keeps no segment of over MEMO_CHARS
#: characters. Bounds memory, not results.
MEMO = 700_000
MEMO_CHARS = 64
PAIRS = 700_000
#: Rows of one output batch, so that the ids of a few hundred texts are held at a time.
ROWS = 256


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_plain(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Rank-ordered merging of one piece, the definition that encode() reproduces. Quadratic; used on short byte strings."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class BytePairEncoder:
    """encode() and decode() for one vocabulary and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int | None = None):
        self.most, self.pairs = memo or MEMO, memo or PAIRS
        self.ranks = ranks
        self.words = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        # a token that its own merges do not produce can only stand for a whole piece
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if merge_plain(token, ranks) == [token]:
                self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.together: dict[int, bool] = {}  # keyed by both ids, 20 bits each
        self.memo: dict[str, tuple[int, ...]] = {}
        self.after: dict[str, tuple[int, ...]] = {}  # keyed without the leading blank

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.together.get(key)
        if known is None:
            if len(self.together) >= self.pairs:
                self.together.clear()
            x, y = self.words[a], self.words[b]
            known = self.together[key] = merge_plain(x + y, self.ranks) == [x, y]
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        return self.encode_pieces([piece])[0]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Each piece by itself. The automaton runs once over all of them, with a character that no byte maps to between."""
        out: list[list[int] | None] = []
        left = []
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            out.append(None if whole is None else [whole])
            if whole is None:
                left.append((k, piece.decode("latin-1")))
        # longest matches from the left; if each goes with the one before, that is the answer
        hard, bounds, p = [], [], 0
        for _, chars in left:
            p += len(chars) + 1
            bounds.append(p)
        ids: list[int] = []
        at, good, end = 0, True, bounds[0] if bounds else 0

        def close() -> None:
            if good:
                out[left[at][0]] = ids
            else:
                hard.append(left[at])

        together, known = self.together, self.compatible
        for last, (_, rank) in self.automaton.iter_long("\u0100".join(chars for _, chars in left)) if left else ():
            while last >= end:
                close()
                at += 1
                ids, good, end = [], True, bounds[at]
            if good and ids:
                ok = together.get(ids[-1] << 20 | rank)
                good = known(ids[-1], rank) if ok is None else ok
            ids.append(rank)
        if left:
            close()
        if hard:
            starts: list[list[tuple[int, int]]] = [[] for _ in range(sum(len(c) + 1 for _, c in hard))]
            for last, (size, rank) in self.automaton.iter("\u0100".join(c for _, c in hard)):
                starts[last - size + 1].append((size, rank))  # ends ascend, so each list is shortest first
            p = 0
            for k, chars in hard:
                out[k] = self._backtrack(starts, p, p + len(chars)) or [self.ranks[t] for t in merge_plain(pieces[k], self.ranks)]
                p += len(chars) + 1
        return out

    def _backtrack(self, starts: list[list[tuple[int, int]]], begin: int, end: int) -> list[int]:
        dead = bytearray(end - begin + 1)
        ids: list[int] = []
        places = [begin]
        choice = [len(starts[begin])]  # at each place, tokens of a lower index are still to be tried
        together, known = self.together, self.compatible
        while places[-1] < end:
            pos = places[-1]
            options, i = starts[pos], choice[-1] - 1
            while i >= 0:
                size, rank = options[i]
                if not dead[pos + size - begin]:
                    ok = together.get(ids[-1] << 20 | rank) if ids else True
                    if known(ids[-1], rank) if ok is None else ok:
                        break
                i -= 1
            choice[-1] = i
            if i >= 0:
                ids.append(rank)
                places.append(pos + size)
                choice.append(len(starts[pos + size]) if pos + size < end else 0)
            elif ids:
                dead[pos - begin] = 1
                places.pop()
                choice.pop()
                ids.pop()
            else:
                return []
        return ids

    def encode_segments(self, found: list[str]) -> list[tuple[int, ...]]:
        pieces: list[bytes] = []
        counts = []
        for segment in found:
            body = segment[1:] if segment[0] == " " else segment
            if not body or body.isalpha():  # one match of the pattern
                own = (segment,)
            elif body[-1] in ".,;:!?" and body[:-1].isalpha() and body[-2] in _LETTERS:
                own = (segment[:-1], segment[-1])
            else:
                own = self.split(segment)
            counts.append(len(own))
            pieces += [x.encode("utf-8") for x in own]
        made = iter(self.encode_pieces(pieces))
        return [tuple(chain.from_iterable(next(made) for _ in range(n))) for n in counts]

    def _learn(self, memo: dict[str, tuple[int, ...]], lead: str, keys: list[str]) -> list[str]:
        """Returns what the memo must not keep."""
        new = [k for k in set(keys) if k not in memo]
        long = [k for k in new if len(k) > MEMO_CHARS]
        if new:
            if len(memo) + len(new) > self.most:
                memo.clear()
                new = list(set(keys))
            memo.update(zip(new, self.encode_segments([lead + k for k in new]), strict=True))
        return long

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, which is cut where a match must begin (see cut()); equal segments are encoded once."""
        got: list[tuple[int, ...]] = []
        lines = cut(text)
        long = self._learn(self.memo, "", [head for head, _ in lines if head])
        after = self._learn(self.after, " ", [word for _, words in lines for word in words])
        for head, words in lines:
            if head:
                got.append(self.memo[head])
            got += map(self.after.__getitem__, words)
        for k in long:
            del self.memo[k]
        for k in after:
            del self.after[k]
        return list(chain.from_iterable(got))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))


def cut(text: str) -> list[tuple[str, list[str]]]:
    """(head, words) in turn; joined, with a blank before each word, they give the text. Cuts are made where the
    splitting pattern must begin a match whatever else the text holds: before a blank, and on both sides of a line feed,
    that stand alone between characters other than white space."""
    out: list[tuple[str, list[str]]] = []
    lines = text.split("\n")
    for k, line in enumerate(lines):
        words = line.split(" ")
        if not line or line.split() != words:  # other white space, or blanks together
            return [(part, []) for part in segments(text)]
        if k:
            out.append(("\n", []))
        out.append((words[0], words[1:]))
    return out


def segments(text: str) -> list[str]:
    """The same cuts at blanks alone, for texts with any white space."""
    out: list[str] = []
    parts = text.split(" ")
    held = parts[0]
    for part in parts[1:]:
        if part and held and not part[0].isspace() and not held[-1].isspace():
            out.append(held)
            held = " " + part
        else:
            held += " " + part
    if held:
        out.append(held)
    return out


_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str, memo: int | None = None) -> BytePairEncoder:
    """One encoder for a Python worker; reused by its later tasks."""
    return BytePairEncoder(read_ranks(path), pattern, memo)


def encode_batches(df: DataFrame, id_col: str, text_col: str, ranks: str | None = None, pattern: str | None = None, columns: tuple[str, ...] = ("ids",), memo: int | None = None) -> DataFrame:
    """One row for each row of df: the id, then of `columns` those asked for: ids (array<int>), n_tokens, ids_sha256,
    decoded (binary, by decoding the ids), decoded_sha256. Null text counts as empty. A smaller memo takes less memory and more time."""
    kinds = {"ids": ("array<int>", pa.list_(pa.int32())), "n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded": ("binary", pa.binary()), "decoded_sha256": ("string", pa.string())}
    path, pattern = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def make():
        e = encoder(path, pattern, memo)
        decimal = {i: str(i) for i in e.words}.__getitem__

        def step(batch):
            out = {c: [] for c in columns}
            for x in batch.column(1):
                ids = e.encode(x.as_py() or "")
                decoded = e.decode(ids) if "decoded" in out or "decoded_sha256" in out else b""
                for c, put in out.items():
                    if c == "ids":
                        put.append(np.array(ids, dtype=np.int32))
                    elif c == "n_tokens":
                        put.append(len(ids))
                    elif c == "ids_sha256":
                        put.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                    elif c == "decoded":
                        put.append(decoded)
                    else:
                        put.append(hashlib.sha256(decoded).hexdigest())
            made = {id_col: batch.column(0)} | {c: pa.array(v, kinds[c][1]) for c, v in out.items() if c != "ids"}
            if "ids" in out:
                ends = np.cumsum([0, *map(len, out["ids"])]).astype(np.int32)
                made["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out["ids"])))
            return made

        return step

    schema = ", ".join([f"{id_col} {df.schema[id_col].dataType.simpleString()}", *(f"{c} {kinds[c][0]}" for c in columns)])
    return map_batches(df.select(id_col, valid(F.col(text_col))), make, schema, ROWS)
