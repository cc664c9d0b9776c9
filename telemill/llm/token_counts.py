"""Token ids and counts of whole texts, with overlap resynchronisation for huge documents.

A text over ``chunk_chars`` is encoded in overlapping chunks. Token offsets of neighbouring chunks are compared inside
the overlap and the two id streams are spliced at the last common boundary that is proven stable: a place where the
byte-level pattern always begins a new pre-token, whatever stands farther away. Those are white space after anything
else, and changes between letters, digits and other characters (but for an apostrophe before letters, and inside
special strings). Ids left of such a place depend on the left chunk alone and ids right of it on the right chunk alone.
The overlap is widened to the nearest such place, farther back (doubling) if the two chunks don't both have it; a
chunk without any is lengthened to the next one. So every character is encoded once, but for the overlaps, and memory
is bounded by the chunk or the longest pre-token, which has to be encoded whole.

Ids are those of the tokenizers library. Texts of common Latin-script characters are encoded by tiktoken with the same
vocabulary file, which is several times faster and gives the same ids (tests hold one against the other); any text
with a character beyond is encoded by tokenizers itself.

Defined cases: a null text counts as empty (no tokens); repeated rows are counted each; a very long text is encoded in
chunks; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.llm.wordhash import slices

#: Characters whose classes (letter, number, space, other) no Unicode version since 5 has changed.
_BEYOND = re.compile("[^\x00-ſ‐-‧€]")
# Ranges of letters, digits and other visible characters whose classes no Unicode version has changed.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſΑ-ΡΣ-ωА-яא-תء-غक-ह가-힣ぁ-ゖァ-ヺ一-龥"
_DIGITS = "0-9"
_OTHERS = r"!-/:-@\[-`{-~、。「」『』【】（）！，：；？।؟،"
_STABLE = re.compile(
    rf"(?<=\S)(?=[ \n])|(?<=[{_LETTERS}])(?=[{_DIGITS}{_OTHERS}])|(?<=[{_DIGITS}])(?=[{_LETTERS}{_OTHERS}])|(?<=[{_OTHERS}])(?=[{_DIGITS}])|(?<=[{_OTHERS}])(?<!')(?=[{_LETTERS}])"
)


def default_paths() -> tuple[str, str]:
    """Places of the vocabulary for tokenizers and of the same vocabulary for tiktoken."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Text to ids. ``ranks_path`` may be empty: then tokenizers encodes everything."""

    def __init__(self, json_path: str, ranks_path: str = "", chunk_chars: int = 1 << 15, overlap_chars: int = 1 << 8):
        self.json_path, self.chunk, self.overlap = json_path, chunk_chars, overlap_chars
        self.fast = self._full = None
        with open(json_path, encoding="utf-8") as text:
            known = json.load(text)
        special = {x["content"]: x["id"] for x in known["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.longest = max(map(len, special), default=0)
        pieces = known["model"]["vocab"]
        sizes = np.zeros(1 + max(max(pieces.values()), *special.values(), 0), np.int32)
        for piece, i in pieces.items():
            sizes[i] = len(piece)  # a byte of the text is one character of a byte-level piece
        for text, i in special.items():
            sizes[i] = len(text.encode())
        self.sizes = sizes
        del known, pieces
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @property
    def full(self):
        """The tokenizers library's own tokenizer, loaded when a text first needs it."""
        if self._full is None:
            from tokenizers import Tokenizer

            self._full = Tokenizer.from_file(self.json_path)
        return self._full

    def encode(self, text: str) -> np.ndarray:
        """Ids of one piece of text, without chunking."""
        if self.fast is not None and not _BEYOND.search(text):
            return np.asarray(self.fast.encode(text, allowed_special="all"), np.uint32)
        return np.asarray(self.full.encode(text, add_special_tokens=False).ids, np.uint32)

    def stream(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a whole text in order, a chunk at a time."""
        start, end = 0, self._reach(text, 0, self.chunk)
        left = self.encode(text[:end])
        while end < len(text):
            size = self.overlap
            while True:
                at = self._last_stable(text, start, end - 1, size)
                if at is None:  # not one place held in the whole chunk: take more text on the left
                    end = self._reach(text, start, 2 * (end - start))
                    left = self.encode(text[start:end])
                    if end == len(text):
                        break
                    size = self.overlap
                    continue
                begin = max(start + 1, at - self.overlap)
                stop = self._reach(text, at, self.chunk)
                right = self.encode(text[begin:stop])
                if (cut := self._splice(text, start, left, begin, right, at)) is not None:
                    yield left[: cut[0]]
                    start, end, left = at, stop, right[cut[1] :]
                    break
                size = 2 * (end - at)
        yield left

    def _stable(self, text: str, low: int, high: int) -> Iterator[int]:
        """Stable places from ``low`` to ``high`` (included), none inside a special string."""
        near, far = max(0, low - self.longest), min(len(text), high + self.longest)
        barred = [m.span() for m in self.special.finditer(text, near, far)]
        for m in _STABLE.finditer(text, low, min(len(text), high + 1)):
            if m.start() <= high and not any(a < m.start() < b for a, b in barred):
                yield m.start()

    def _last_stable(self, text: str, start: int, end: int, size: int) -> int | None:
        """The last stable place at least ``size`` before ``end`` if there is one after ``start``, looked for in doubling reaches."""
        high, reach = end - size + self.overlap, self.overlap
        while high > start:
            low = max(start + 1, high - reach)
            places = list(self._stable(text, low, high))
            if places:
                return places[-1]
            high, reach = low - 1, 2 * reach
        return None

    def _reach(self, text: str, start: int, size: int) -> int:
        """Where a chunk from ``start`` on ends: after ``size`` characters, or later if no stable place lies among them."""
        end = start + size
        if end >= len(text) or self._last_stable(text, start, end - 1, self.overlap) is not None:
            return min(end, len(text))
        while end < len(text):
            ahead = min(len(text), end + size)
            if (at := next(self._stable(text, end, ahead), None)) is not None:
                return min(len(text), at + self.overlap + 1)
            end = ahead
        return len(text)

    def _splice(self, text: str, start: int, left: np.ndarray, begin: int, right: np.ndarray, at: int) -> tuple[int, int] | None:
        """Counts of left ids before and right ids before ``at``, if both chunks have a boundary there."""
        found = []
        for first, ids in ((start, left), (begin, right)):
            ends, own = np.cumsum(self.sizes[ids]), len(text[first:at].encode())
            i = int(np.searchsorted(ends, own))
            if i == len(ends) or ends[i] != own:
                return None
            found.append(i + 1)
        return found[0], found[1]

    def ids(self, text: str) -> np.ndarray:
        return np.concatenate(list(self.stream(text)))

    def count(self, text: str) -> int:
        return sum(map(len, self.stream(text)))


@lru_cache(maxsize=4)
def encoder(json_path: str, ranks_path: str = "", chunk_chars: int = 1 << 15, overlap_chars: int = 1 << 8) -> Encoder:
    """One encoder a worker process."""
    return Encoder(json_path, ranks_path, chunk_chars, overlap_chars)


def count_tokens(df: DataFrame, text: str = "text", paths: tuple[str, str] | None = None, limit: int = 512, chunk_chars: int = 1 << 15, overlap_chars: int = 1 << 8) -> DataFrame:
    """The rows without ``text``, with n_bytes, n_tokens (long) and over_limit (n_tokens > limit)."""
    args = (*(paths or default_paths()), chunk_chars, overlap_chars)
    rest = [c for c in df.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    body = F.coalesce(F.col(text), F.lit(""))
    slot = "_text" + "_" * max(map(len, df.columns))  # longer than any other name
    slim = df.select(*rest, F.octet_length(body).cast("long").alias("n_bytes"), body.alias(slot))
    schema = T.StructType([*(slim.schema[c] for c in rest), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(*args)
        for batch in slices(batches):
            counts = [e.count(t.as_py()) for t in batch.column(slot)]
            columns = [batch.column(c) for c in (*rest, "n_bytes")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*rest, "n_bytes", "n_tokens"])

    return slim.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
