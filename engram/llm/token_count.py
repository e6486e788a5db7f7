"""Token counts as the library for a vocabulary gives them, with overlap resynchronisation for huge documents.

A document beyond `chunk_chars` is encoded by the library in overlapping chunks with offsets. Two chunks are spliced at a place
in their overlap where both start a token and which is proven stable: a blank, or a line feed, between two characters that are not white
space always begins a pre-token, whatever stands around it, so from there on both encodings are that of the whole text, as far as a
later such place. Where an overlap holds no such place on which both agree, it is doubled and the left chunk is encoded
again up to its new end; at worst a chunk becomes the whole rest of the text. The count is that of the chunks' own tokens between splices.
Shorter texts are cut at the same places, and equal segments are encoded once per worker.

Only byte-level vocabularies with a white-space pre-tokeniser have such proven places; for others (.model files, word
BPE) each text is encoded whole.

Cases: null text counts as empty: 0 bytes, 0 tokens; strings of special tokens inside a text are treated as the library
does by default; no truncation, no padding, no added tokens; bytes that are not UTF-8 count as the replacement character.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm._common import map_batches, valid
from engram.llm.bpe import MEMO_CHARS, cut

CHUNK_CHARS = 65_536
OVERLAP_CHARS = 512
#: Segments remembered by a Python worker, of MEMO_CHARS characters at most; the memo is emptied when it is full. Bounds memory, not results.
MEMO = 700_000


class TokenCounter:
    def __init__(self, path: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.chunk, self.overlap = chunk_chars, overlap_chars
        self.memo: dict[str, int] = {}
        self.after: dict[str, int] = {}
        self.piece = path.endswith(".model")
        self.stable = False
        #: Of the last huge text: the splices, and how often an overlap was doubled.
        self.splices: list[int] = []
        self.widened = 0
        if self.piece:
            import sentencepiece

            self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            self.lib = Tokenizer.from_file(path)
            self.lib.no_truncation()
            self.lib.no_padding()
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            pre = spec.get("pre_tokenizer") or {}
            # a special string with white space in it, or one that strips, could reach over a blank
            plain = all(not t.get("lstrip") and not t.get("rstrip") and not any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
            self.stable = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and plain

    def _library(self, texts: list[str]) -> list[int]:
        if self.piece:
            return [len(x) for x in self.lib.encode(texts, num_threads=1)] if texts else []
        return [len(x) for x in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, text: str) -> int:
        if not self.stable:
            return self._library([text])[0]
        return self._count_huge(text) if len(text) > self.chunk else self._count_plain(text)

    def _count_plain(self, text: str) -> int:
        total = 0
        for head, words in cut(text):
            if head:
                total += self._known(self.memo, "", [head])
            if words:
                total += self._known(self.after, " ", words)
        return total

    def _known(self, memo: dict[str, int], lead: str, parts: list[str]) -> int:
        new = [p for p in set(parts) if p not in memo]
        long = [p for p in new if len(p) > MEMO_CHARS]
        if new:
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = list(set(parts))
            memo.update(zip(new, self._library([lead + p for p in new]), strict=True))
        total = sum(map(memo.__getitem__, parts))
        for p in long:
            del memo[p]
        return total

    def _starts(self, text: str, begin: int, end: int) -> np.ndarray:
        """Where in the text the tokens of the library's own encoding of text[begin:end] start. Its offsets leave leading white space out, which
        belongs to the token all the same; of a character in several tokens each has the place."""
        both = np.array(self.lib.encode(text[begin:end], add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2)
        return begin + np.minimum(both[:, 0], np.append(0, both[:-1, 1]))

    def _splice(self, text: str, lo: int, hi: int, left: np.ndarray, right: np.ndarray) -> int | None:
        """The first place in lo..hi at which both encodings start a token and which is proven stable."""
        both = np.intersect1d(left[(left >= max(lo, 1)) & (left < hi)], right)
        for p in both.tolist():
            if text[p] in " \n" and p + 1 < len(text) and not text[p - 1].isspace() and not text[p + 1].isspace():
                return p
        return None

    def _count_huge(self, text: str) -> int:
        n, total = len(text), 0
        self.splices, self.widened = [], 0
        begin, start, end = 0, 0, min(len(text), self.chunk)  # of the chunk, and of its tokens that count
        left = self._starts(text, begin, end)
        while end < n:
            overlap, place = self.overlap, None
            while place is None:
                after = max(start + 1, end - overlap)
                stop = min(n, after + max(self.chunk, 2 * (end - after)))
                right = self._starts(text, after, stop)
                place = self._splice(text, after, end, left, right)
                if place is None:
                    self.widened += 1
                    if end == n:  # nothing to splice: the left chunk holds the whole rest
                        break
                    end = min(n, end + overlap)
                    left = self._starts(text, begin, end)
                    overlap *= 2
            if place is None:
                break
            total += int(((left >= start) & (left < place)).sum())
            self.splices.append(place)
            begin, start, end, left = after, place, stop, right
        return total + int((left >= start).sum())


@lru_cache(maxsize=4)
def counter(path: str, chunk_chars: int, overlap_chars: int) -> TokenCounter:
    return TokenCounter(path, chunk_chars, overlap_chars)


def count_tokens(df: DataFrame, id_col: str, text_col: str, path: str | None = None, limit: int = 1024, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """One row for each row of df: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def make():
        c = counter(path, chunk_chars, overlap_chars)

        def step(batch):
            size, tokens = [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                size.append(len(text.encode("utf-8")))
                tokens.append(c.count(text))
            return {id_col: batch.column(0), "n_bytes": pa.array(size, pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "over_limit": pa.array([n > limit for n in tokens], pa.bool_())}

        return step

    return map_batches(df.select(id_col, valid(F.col(text_col))), make, f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
