"""Token counts with a whole-token shortcut for sentencepiece models.

The text is cut into pre-tokens, each a run of spaces with the word after it.
No piece of the vocabulary holds a space after another character (checked when
the model is loaded), so merges never reach across pre-tokens and the count of
a text is the sum over its pre-tokens. Offline, each vocabulary string that the
library itself encodes as one token is listed; such pre-tokens count 1 without
merging, and only the rest goes through the library, once per distinct word and
batch.

Semantics for odd input: null and empty texts have 0 bytes and 0 tokens; texts
are counted whole, whatever their length; repeated rows are counted alike; an
empty table gives an empty result. Only the columns named are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks

SPACE = "▁"
#: Counts of merged words that a task remembers, in characters of the words; beyond it starts anew.
MEMO_CHARS = 8_000_000
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceCounter:
    """Counts tokens as ``SentencePieceProcessor.encode`` gives them, without begin or end tokens."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        # Merges stay inside pre-tokens if spaces only stand at the front of pieces, and the text is taken as it is.
        probe = " é  Aﬁ① \t\n x "
        self.by_unit = not any(SPACE in p.lstrip(SPACE) for p in plain) and self.model.normalize(probe) == SPACE + probe.replace(" ", SPACE)
        starts = [p for p in plain if p.startswith(SPACE)]
        self.whole = {p[1:] for p, ids in zip(starts, self.model.encode([p[1:].replace(SPACE, " ") for p in starts]), strict=True) if len(ids) == 1}
        self.space = len(self.model.encode("a ")) - len(self.model.encode("a"))  # what a last lone space adds
        self.memo: dict[str, int] = {"": self.space}
        self.held = 0

    def _merged(self, words: list[str]) -> dict[str, int]:
        """Counts of pre-tokens, given without their first space, that are no whole tokens."""
        memo = self.memo
        new = [w for w in words if w not in memo]
        got = dict(zip(new, map(len, self.model.encode([w.replace(SPACE, " ") for w in new], num_threads=1)), strict=True)) if new else {}
        self.held += sum(map(len, new)) + 60 * len(new)
        if self.held > MEMO_CHARS * 4:
            self.memo, self.held = {"": self.space}, 0
            got |= {w: memo[w] for w in words if w not in got}
            return got
        memo.update(got)
        return memo

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_unit:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        split, odd = [], SPACE * 2
        for t in texts:
            t = t.replace(" ", SPACE) if t else ""
            # A single space between words is the common case, and then the pieces between spaces are the pre-tokens.
            split.append(t.split(SPACE) if odd not in t and t[:1] != SPACE and t[-1:] != SPACE else [u[1:] for u in _UNIT.findall(SPACE + t)] if t else [])
            if t == "":
                split[-1] = []
        seen = Counter()
        for words in split:
            seen.update(words)
        rest = [w for w in seen if w not in self.whole]
        known = self._merged(rest)
        whole = self.whole
        counts = {w: 1 if w in whole else known[w] for w in seen}
        return [sum(map(counts.__getitem__, words)) for words in split]


@lru_cache(maxsize=4)
def counter_for(model_file: str) -> PieceCounter:
    """One counter per worker process and model."""
    return PieceCounter(model_file)


def count_tokens(df: DataFrame, model_name: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """Per row: key, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    ``model_name`` names a file of the installed vocabulary package; the path is
    looked up where the task runs.
    """
    import public_tokenizers

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(public_tokenizers.path(model_name))
        for batch in batches:
            for part, texts in chunks(batch, text):
                n = counter.count([t.decode() for t in texts])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=[key, "n_bytes", "n_tokens", "over_limit"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
