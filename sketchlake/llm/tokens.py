"""Token counts by a public tokenizer, exact for texts of any length.

Texts of up to ``chunk`` characters are encoded as they are. A longer one is
encoded in overlapping chunks with offsets, and neighbouring chunks are spliced
where both begin a pre-token. Such a boundary is proven stable: in the earlier
chunk it lies far enough from the cut for no look-ahead of the splitting pattern
and no special string to reach beyond it, so the whole text has it too; and
what follows a boundary of the whole text depends on nothing before it, so the
later chunk, which begins a pre-token there as well, agrees with the whole text
from there on, up to its own cut. Where an overlap has no such boundary (one
endless word) it is widened, and then the earlier chunk lengthened.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sketchlake.llm.runtime import lean, ship

CHUNK, OVERLAP, BATCH_CHARACTERS = 1 << 13, 512, 1 << 20
#: Characters after a boundary that the splitting pattern may look at (contractions, white space runs), at most.
LOOK_AHEAD = 4


@lru_cache(maxsize=4)
def load(path: str):
    """A tokenizers or sentencepiece tokenizer, once per process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def _begins(encoding, at: int) -> dict[int, int]:
    """Where pre-tokens begin in the whole text, with the number of the token there; ``at`` is the chunk's place."""
    out, last = {}, object()
    for i, (word, (start, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word is None or word != last:
            out.setdefault(at + start, i)
        last = object() if word is None else word
    return out


def resynchronised(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[int]]:
    """The ids of a text, in parts whose concatenation is the encoding of the whole."""
    margin = LOOK_AHEAD + max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0)
    encode = lambda a, b: tokenizer.encode(text[a:b], add_special_tokens=False)
    start, end, skip = 0, min(chunk, len(text)), 0
    now = encode(start, end)
    while end < len(text):
        wide = max(overlap, margin + 1)
        while True:
            other = max(end - wide, start + 1)
            ahead = min(max(other + chunk, end + chunk // 2), len(text))
            then = encode(other, ahead)
            begins = _begins(now, start)
            joins = [(p, i) for p, i in _begins(then, other).items() if other < p <= end - margin and begins.get(p, -1) >= skip]
            if joins:
                p, first = joins[0]
                yield now.ids[skip : begins[p]]
                now, start, end, skip = then, other, ahead, first
                break
            if other > start + 1:
                wide *= 2
            else:
                end = min(end + chunk, len(text))
                now = encode(start, end)
                if end == len(text):
                    break
    yield now.ids[skip:]


def count_tokens(tokenizer, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    if not hasattr(tokenizer, "encode_batch_fast"):
        return [len(x) for x in tokenizer.encode(texts, out_type=int, add_bos=False, add_eos=False, num_threads=1)] if texts else []
    out = [0] * len(texts)
    held: list[int] = []
    size = 0
    for i, text in enumerate([*texts, ""]):
        if held and (i == len(texts) or size + len(text) > BATCH_CHARACTERS):
            for k, found in zip(held, tokenizer.encode_batch_fast([texts[k] for k in held], add_special_tokens=False), strict=True):
                out[k] = len(found)
            held, size = [], 0
        if i < len(texts) and len(text) > chunk:
            out[i] = sum(map(len, resynchronised(tokenizer, text, chunk, overlap)))
        elif i < len(texts):
            held.append(i)
            size += len(text)
    return out


def _count(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [x or "" for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(count_tokens(tokenizer, texts, chunk, overlap), pa.int64())], ["row", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``row`` (the document's own columns), ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    ``path`` names a tokenizer file that every executor has: .json for
    tokenizers, .model for sentencepiece (which encodes texts whole). A null
    text counts as empty: no bytes, no tokens. No begin, end or padding tokens,
    no truncation; special strings within texts are taken as the library does by
    default. Repeated rows are counted each; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns], F.octet_length(text).cast("long").alias("__bytes")).alias("row"), text.alias("text"))
    schema = T.StructType().add("row", packed.schema["row"].dataType).add("n_tokens", "long")
    counted = packed.mapInArrow(lean(_count(path, chunk, overlap)), schema)
    return counted.select(F.col("row").dropFields("__bytes").alias("row") if docs.columns else F.struct().alias("row"), F.col("row.__bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
